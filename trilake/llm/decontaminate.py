"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from trilake.llm.common import filter_texts, map_texts, stored

#: Consecutive words of an item that must occur; shorter items must occur whole.
WINDOW = 10
#: Bytes of benchmark text in one automaton; a larger benchmark is searched in blocks.
BLOCK_BYTES = 4 << 20
#: What is no word becomes a space, A-Z become lower case; bytes from 0x80 on stay.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows(raw: bytes) -> set[bytes]:
    """The windows of an item, each between spaces; none if it has no word."""
    words = normal_words(raw)
    last = max(1, len(words) - WINDOW + 1) if words else 0
    return {b" %s " % b" ".join(words[i : i + WINDOW]) for i in range(last)}


class Matcher:
    """Searches texts for the windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        owners: dict[bytes, list[str]] = {}
        for item, raw in items:
            for window in windows(raw):
                owners.setdefault(window, []).append(item)
        self.automaton = ahocorasick.Automaton()
        for window, of in owners.items():
            # latin-1 keeps one character for each byte
            self.automaton.add_word(window.decode("latin-1"), (len(window), of))
        if owners:
            self.automaton.make_automaton()

    def find(self, raw: bytes) -> tuple[int, list[int], list[str]]:
        """Number of words, numbers of the words inside an occurrence, ids of the items found."""
        words = normal_words(raw)
        if not words or not len(self.automaton):
            return len(words), [], []
        joined = b" %s " % b" ".join(words)
        found = list(self.automaton.iter(joined.decode("latin-1")))
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        ends = np.array([end for end, _ in found])
        first = np.searchsorted(spaces, ends - np.array([size for _, (size, _) in found]) + 1)
        last = np.searchsorted(spaces, ends)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, last, -1)
        hit = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        return len(words), hit.tolist(), sorted({i for _, (_, of) in found for i in of})

    def spans(self, text: str) -> list[list[int]]:
        """The runs of hit words as spans of the text itself, in code points."""
        _, hit, _ = self.find(text.encode())
        if not hit:
            return []
        words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
        inside = np.zeros(len(words), bool)
        inside[hit] = True
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        return [[words[a][0], words[b - 1][1]] for a, b in edges.reshape(-1, 2).tolist()]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Callable[[], Matcher]]:
    """Makers of matchers that together hold the whole benchmark, each of about `block_bytes` at most.

    Items are dealt into blocks by a hash of their row; a block is fetched and broadcast
    only when it is asked for. A worker builds the automaton once for each task.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    for b in range(blocks):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield _maker(benchmark.sparkSession, [(r.id, r.text.encode()) for r in rows.collect()])


def _maker(spark: SparkSession, items: list[tuple[str, bytes]]) -> Callable[[], Matcher]:
    shared = spark.sparkContext.broadcast(items)
    built: list[Matcher] = []

    def matcher() -> Matcher:
        if not built:
            built.append(Matcher(shared.value))
        return built[0]

    return matcher


FOUND = StructType(
    [StructField("n_words", LongType()), StructField("hit", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]
)


def _found(docs: DataFrame, matcher: Callable[[], Matcher], *keep: Column | str) -> DataFrame:
    rows = docs.select("doc_id", *keep, F.col("text").alias("_text"))
    return map_texts(rows, "_text", lambda texts: [matcher().find(t) for t in texts], FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of the benchmark occurs in each document: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated.

    Words: A-Z lower-cased, runs of ASCII digits, letters and characters beyond ASCII.
    A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter one.
    A document word inside any occurrence of a window is hit.

    Null and empty texts have no words; an item without words never occurs. A null
    item_id counts as an empty one; items with one id count once. Repeated documents are
    judged alike. An empty benchmark contaminates nothing. Other columns are ignored.
    """
    found = None
    for matcher in item_blocks(benchmark, block_bytes):
        if found is None:
            found = _found(docs, matcher, "text")
            continue
        # blocks follow each other along a document; a written table keeps the plan from growing with their number
        earlier = stored(found, "decontaminate")
        more = _found(earlier, matcher, "text", F.struct("hit", "items").alias("earlier"))
        merged = [F.array_union(c, f"earlier.{c}").alias(c) for c in ("hit", "items")]
        found = more.select("doc_id", "text", "n_words", *merged)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


SPANS = StructType([StructField("spans", ArrayType(ArrayType(LongType())))])


def hit_spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, start, end: the contaminated stretches of each text, in code points of the
    text as it is. Stretches found by different benchmark blocks are rows of their own."""
    parts = [_spans(docs, matcher) for matcher in item_blocks(benchmark, block_bytes)]
    return functools.reduce(DataFrame.unionByName, parts)


def _spans(docs: DataFrame, matcher: Callable[[], Matcher]) -> DataFrame:
    spans = map_texts(
        docs.select("doc_id", "text"), "text", lambda texts: [(matcher().spans(t.decode("utf-8", "replace")),) for t in texts], SPANS
    )
    one = spans.select("doc_id", F.explode("spans").alias("span"))
    return one.select("doc_id", F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit word, in all their columns."""
    for matcher in item_blocks(benchmark, block_bytes):
        docs = _clean(docs, matcher)
    return docs


def _clean(docs: DataFrame, matcher: Callable[[], Matcher]) -> DataFrame:
    return filter_texts(docs, "text", lambda texts: [not matcher().find(t)[1] for t in texts])
