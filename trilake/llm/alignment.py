"""Two tokenizers aligned over a corpus: shared cuts, linked ids, and how common each link is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilake.llm.common import small_batches
from trilake.llm.tokens import BYTE_BPE, PIECE_BPE, ByteBpe, Pieces
from trilake.session import kept, scratch_dir

#: Bytes of distinct texts whose pairs are counted and looked up together.
CHUNK_BYTES = 8 << 20
#: Links of one group up to which they are laid out one by one.
LARGE_GROUP = 10_000
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ALIGNED = (
    "chunk long, key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a array<int>, b array<int>, n array<long>"
)
#: Bits of a pair's second id.
SHIFT = 32


class Alignment:
    """What two tokenizers make of one text; without tokens if they do not spell it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, bytes_a: list[bytes], bytes_b: list[bytes], raw: bytes):
        parts = [list(map(t.__getitem__, ids.tolist())) for ids, t in ((a, bytes_a), (b, bytes_b))]
        spelled = all(b"".join(p) == raw for p in parts)
        self.a, self.b = (a, b) if spelled else (a[:0], b[:0])
        if not spelled:
            return
        ends = [np.cumsum(np.fromiter(map(len, p), np.int64, len(p))) for p in parts]
        cut = np.zeros((2, len(raw) + 1), bool)
        for at, of in zip(cut, ends):
            at[of] = True
        both = cut.all(axis=0)
        place = np.cumsum(both) - both  # groups that end before a byte
        self.in_a, self.in_b = (place[of] for of in ends)
        groups = int(both.sum())
        self.size_a, self.size_b = np.bincount(self.in_a, minlength=groups), np.bincount(self.in_b, minlength=groups)

    def measures(self) -> tuple[int, int, int, int]:
        return len(self.a), len(self.b), len(self.size_a), int((self.size_a * self.size_b).sum())

    def shown(self, marked: list[bytes]) -> bytes:
        """`a1,a2|b1;a3|b2,b3`; `marked` has each id with a comma, with a bar and with a semicolon."""
        first_a, first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + first_b[self.in_a]
        at_b = np.arange(len(self.b)) + (first_a + self.size_a)[self.in_b]
        codes[at_a], codes[at_b] = self.a, self.b
        codes *= 3
        codes[at_a[first_a + self.size_a - 1]] += 1
        codes[at_b[first_b + self.size_b - 1]] += 2
        return b"".join(map(marked.__getitem__, codes.tolist()))[:-1]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs, first id in the upper bits, and how often each is linked."""
        first_b = np.cumsum(self.size_b) - self.size_b
        large = self.size_a * self.size_b > LARGE_GROUP
        partners = np.where(large[self.in_a], 0, self.size_b[self.in_a])
        step = np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)
        other = self.b[np.repeat(first_b[self.in_a], partners) + step]
        pairs, times = [np.repeat(self.a, partners).astype(np.int64) << SHIFT | other], [np.ones(len(other), np.int64)]
        first_a = np.cumsum(self.size_a) - self.size_a
        for g in np.flatnonzero(large).tolist():  # by distinct ids, as the pairs of places may be too many
            own, n = np.unique(self.a[first_a[g] : first_a[g] + self.size_a[g]], return_counts=True)
            other, m = np.unique(self.b[first_b[g] : first_b[g] + self.size_b[g]], return_counts=True)
            pairs.append((own.astype(np.int64)[:, None] << SHIFT | other).ravel())
            times.append((n[:, None] * m).ravel())
        found, at = np.unique(np.concatenate(pairs), return_inverse=True)
        return found, np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)


class Aligner:
    """Texts to (n_a, n_b, n_groups, n_links, digest, pairs, times), or None without tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.first, self.second = ByteBpe(byte_bpe, special=False).load(), Pieces(piece_bpe)
        ids = range(max(len(self.first.table), len(self.second.table)))
        self.marked = [f"{i}{mark}".encode() for i in ids for mark in ",|;"]

    def __call__(self, text: str) -> tuple | None:
        raw = f" {text}".encode()
        found = Alignment(self.first(" " + text), self.second(text), self.first.table, self.second.table, raw)
        if not len(found.a):
            return None
        return (*found.measures(), hashlib.sha256(found.shown(self.marked)).hexdigest(), *found.links())


def _aligned(byte_bpe: str, piece_bpe: str):
    """Distinct texts to rows of their measures and pairs, and after each chunk one row
    without a key: its distinct pairs and how many documents hold each."""

    def split(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (pairs >> SHIFT).astype(np.int32), (pairs & ((1 << SHIFT) - 1)).astype(np.int32)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = Aligner(byte_bpe, piece_bpe)
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64())]
        schema = pa.schema([(c.split()[0], t) for c, t in zip(ALIGNED.split(", "), types)])

        def rows(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*values), types)], schema=schema)

        def summary() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            copies = np.repeat(np.array([c for _, c in held], np.float64), [len(p) for p, _ in held])
            counts = np.bincount(places, copies, len(pairs)).astype(np.int64)
            return rows([(chunk, None, None, None, None, None, None, None, *split(pairs), counts)])

        for batch in batches:
            done = []
            for key, raw, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "copies"))):
                found = align(raw.decode("utf-8", "replace"))
                if found is not None and found[0]:
                    *sums, digest, pairs, times = found
                    done.append((chunk, key, copies, *sums, digest, *split(pairs), times))
                    held.append((pairs, copies))
                    size += len(raw)
                if size >= CHUNK_BYTES:
                    yield rows(done)
                    yield summary()
                    chunk, size, held, done = chunk + 1, 0, [], []
            if done:
                yield rows(done)
        if held:
            yield summary()

    return partition


def _measured(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of a chunk with their links of highest count and the sum of their links' counts."""
    known = (pairs.column("a").to_numpy().astype(np.int64) << SHIFT) + pairs.column("b").to_numpy()
    order = np.argsort(known)
    known = known[order]
    count = pairs.column("count").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order].astype(bool)
    texts = texts.combine_chunks()
    a, b, n = (texts.column(c).chunk(0) for c in ("a", "b", "n"))
    at = np.searchsorted(known, (a.flatten().to_numpy().astype(np.int64) << SHIFT) + b.flatten().to_numpy())
    times = n.flatten().to_numpy()
    first = np.r_[0, np.cumsum(n.value_lengths().to_numpy())[:-1]]  # no text here is without links
    n_best, count_sum = np.add.reduceat(times * best[at], first), np.add.reduceat(times * count[at], first)
    done = texts.drop_columns(["chunk", "copies", "a", "b", "n"])
    return done.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """A written table of all distinct texts with tokens, in chunks, their pairs with them.

    Texts meet by a shuffle of the whole text, counted before it; each is tokenised and
    aligned once. A chunk is what one task read in a row, ``CHUNK_BYTES`` of text (or one
    text); each has one more row (folder ``summary=true``) with its distinct pairs and how
    many documents hold them, so what is shuffled later grows with chunks' distinct pairs
    and not with tokens.
    """
    small_batches(docs.sparkSession)
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    texts = distinct.select(F.sha2("text", 256).alias("key"), F.col("text").cast("binary").alias("text"), "copies")
    path = scratch_dir(docs.sparkSession, "alignment-texts")
    rows = texts.mapInArrow(_aligned(byte_bpe, piece_bpe), ALIGNED).withColumn("summary", F.col("key").isNull())
    rows.write.partitionBy("summary").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(f"{ALIGNED}, summary boolean").parquet(path)


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, count (documents of the corpus that hold the pair) and best (no pair of its `a` has more).

    `table` is the result of `aligned`. There is one highest count for each id of the first
    vocabulary, which bounds what is broadcast.
    """
    held = table.where("summary").select("chunk", F.inline(F.arrays_zip("a", "b", "n")))
    counts = kept(held.groupBy("a", "b").agg(F.sum("n").alias("count")), "alignment-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("_highest"))
    return counts.join(F.broadcast(highest), "a").withColumn("best", F.col("count") == F.col("_highest")).drop("_highest")


def alignment(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of all rows.

    Tokens are those of a space and the text. A group lies between two places where tokens
    of both end; all its tokens of one side link to all of the other. Measures are computed
    once for each distinct text and joined to its rows by the text's SHA-256; the count of
    a pair counts rows, so repeated rows and copies count each time.

    Null and empty texts, and those that the tokens of a side do not spell byte by byte,
    have zeros and an empty digest, and count for nothing. No rows give none; other columns
    are ignored, also those with the names of the output.
    """
    table = aligned(docs, byte_bpe, piece_bpe)
    held = table.where("summary").select("chunk", F.inline(F.arrays_zip("a", "b")))
    wanted = held.join(pair_counts(table), ["a", "b"]).select(F.col("chunk").alias("place"), "a", "b", "count", "best")
    texts = table.where("not summary").drop("summary")
    out = "key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    measured = kept(texts.groupBy("chunk").cogroup(wanted.groupBy("place")).applyInArrow(_measured, out), "alignment-measures")
    keyed = docs.select("doc_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("key"))
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES]
    return keyed.join(measured, "key", "left").select("doc_id", *sums, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
