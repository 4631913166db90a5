"""Near duplicates by SimHash, linked through a hierarchical index in Gray order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trilake.llm.common import map_texts, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BITS = 64
#: Children of a node of the index, and query-fingerprint pairs that a step down may hold.
FANOUT, PAIRS = 16, 2_000_000
#: Fingerprints in one unit of comparison; a larger bucket is compared slice against slice.
SLICE = 50_000
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text in UTF-8, as a signed 64-bit number; 0 without words."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.r_[0, np.cumsum(lengths)]
    ends = (starts[SHINGLE : SHINGLE + n] if len(words) >= SHINGLE else starts[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the reflected Gray sequence; neighbours there differ by few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under levels of nodes.

    A node holds the bits on which all fingerprints below it agree (`mask`) and their
    values (`pattern`); bits that its parent holds already are left out, so a search adds
    up the differences on its way down and drops a whole group once there are too many.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaf = codes[self.order]
        ones, zeros = [leaf], [~leaf]
        while len(ones[-1]) > 1:
            cut = np.arange(0, len(ones[-1]), FANOUT)
            ones.append(np.bitwise_and.reduceat(ones[-1], cut))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], cut))
        self.levels = []  # from the root down: mask without the parent's, pattern
        for level in range(len(ones) - 1, -1, -1):
            mask = ones[level] | zeros[level]
            if level + 1 < len(ones):
                above = ones[level + 1] | zeros[level + 1]
                mask = mask & ~np.repeat(above, FANOUT)[: len(mask)]
            self.levels.append((mask, ones[level]))

    def pairs(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of fingerprints that differ by at most `most` bits."""
        step = max(1, PAIRS // len(self.order))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(len(queries), at + step))
            node = np.zeros(len(q), np.int64)
            bits = np.zeros(len(q), np.int64)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    q, bits = np.repeat(q, FANOUT), np.repeat(bits, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    real = node < len(mask)
                    q, bits, node = q[real], bits[real], node[real]
                bits = bits + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
                near = bits <= most
                q, bits, node = q[near], bits[near], node[near]
            yield q, self.order[node]


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """The bits cut into blocks of about equal width."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def key_tables(most: int, n: int) -> list[tuple[tuple[int, int], ...]]:
    """The bits that make the keys of each bucket table, for `n` fingerprints.

    Of `most` + t blocks, two codes at most `most` bits apart agree in at least t, so
    one table for each choice of t blocks misses no pair. More blocks together make
    longer keys and smaller buckets, at the price of more tables: t is the least from 1
    to 3 for which evenly spread fingerprints fill a bucket of the shortest key with no
    more than ``SLICE``.
    """
    t = next((t for t in (1, 2) if n <= SLICE << t * (BITS // (most + t))), 3)
    return list(itertools.combinations(block_bounds(most + t), t))


def _key(bits: tuple[tuple[int, int], ...]) -> Column:
    """The blocks of a fingerprint side by side as one number."""
    key = F.lit(0).cast("long")
    for lo, hi in bits:
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        key = F.shiftleft(key, hi - lo).bitwiseOR(part)
    return key


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _links(codes: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A forest over the codes that connects all that links between left and right connect.

    The forest, not all pairs, is what leaves: a group of near copies gives one link for
    each member.
    """
    index = GrayIndex(codes[right])
    root = np.arange(len(codes))
    for q, r in index.pairs(codes[left], most):
        a, b = root[left[q]], root[right[r]]
        apart = a != b
        if apart.any():
            root = _roots(len(codes), a[apart], b[apart])[root]
    child = np.flatnonzero(root != np.arange(len(codes)))
    return list(zip(child.tolist(), root[child].tolist()))


def _linked(most: int):
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True).sort_values(["block", "value", "a", "b"], kind="stable")
        keys = rows[["block", "value", "a", "b"]].to_numpy()
        cuts = np.r_[0, 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), len(keys)]
        codes = rows["fp"].to_numpy().view(np.uint64)
        slices = rows["slice"].to_numpy()
        out: list[tuple[int, int]] = []
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            if hi - lo > 1:
                a, b = keys[lo, 2], keys[lo, 3]
                left, right = np.flatnonzero(slices[lo:hi] == a), np.flatnonzero(slices[lo:hi] == b)
                out += [(lo + x, lo + y) for x, y in _links(codes[lo:hi], left, right, most)]
        signed = codes.view(np.int64)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        yield pd.DataFrame({"u": signed[pairs[:, 0]], "v": signed[pairs[:, 1]]})

    return partition


def links(codes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Links u, v between fingerprints that together connect all that are near.

    `codes`: distinct fp, in a stored table. Each is sent to one bucket of every table of
    `key_tables`, and every bucket is searched through a Gray-order index. A bucket of
    more than ``SLICE`` fingerprints becomes all pairs of its slices, each a unit of its own.
    """
    tables = enumerate(key_tables(most, codes.count()))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), _key(bits).alias("value")) for i, bits in tables])
    dealt = codes.select("fp", F.explode(blocks).alias("at")).select("fp", "at.block", "at.value")
    sizes = dealt.groupBy("block", "value").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    large = stored(sizes.where("slices > 1"), "simhash-large")
    sliced = dealt.join(large, ["block", "value"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    units = sliced.withColumn("other", other).select(
        "fp", "block", "value", "slice", F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b")
    )
    placed = units.repartition("block", "value", "a", "b")
    return placed.mapInPandas(_linked(most), "u long, v long")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node and root for every node of `edges` (u, v): all nodes of a component share a root.

    Large-star and small-star rounds, each a join with per-node minima that are combined
    before their shuffle; a round is a written table, so no lineage builds up.
    """
    edges = stored(edges.where("u <> v").distinct(), "simhash-edges")
    previous = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that adaptive execution can split the links of a hub
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "simhash-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "simhash-large-star")
        # every edge now points from the larger to the smaller end
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        small = large.join(least, "u")
        small = (
            small.select("v", "m").union(small.select(F.col("u").alias("v"), "m")).where("v <> m")
            .distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = stored(small, "simhash-small-star")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == previous:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        previous = state
    raise RuntimeError("components did not settle")


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` with `fp` in place of its text."""
    return map_texts(docs, "text", lambda texts: [(fingerprint(t),) for t in texts], StructType([StructField("fp", LongType())]))


def classes(codes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """fp and root: the class of each distinct fingerprint of `codes` that has a link."""
    return components(links(codes, most))


def near_duplicates(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable through links, for each row.

    Fingerprints link at `most` or fewer differing bits, texts without words (fingerprint
    zero) like any other. Null and empty texts have no words. A component of only null
    doc_ids has a null component_id. Repeated rows share their component; other columns
    are ignored; no rows give none.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text")), "simhash-prints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes")
    roots = stored(classes(codes.select("fp"), most).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    rooted = stored(codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(named, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (null last), then
    the smallest hash of its text, then of all its columns; all columns of `docs` as they are.

    Which of several wholly equal rows stays makes no difference. Columns of maps are not
    hashed: rows that differ in those alone are taken as equal.
    """
    hashable = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    tie = F.struct(F.xxhash64("text").alias("text"), F.xxhash64(*hashable).alias("row"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id"), tie.alias("tie"))
    prints = stored(fingerprints(docs.select("doc_id", tie.alias("tie"), "text")), "simhash-prints")
    codes = prints.select("fp").distinct()
    roots = stored(classes(codes, most).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("best")
    by_print = prints.groupBy("fp").agg(best)  # first per fingerprint, so copies don't meet in one task
    kept = by_print.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = stored(kept.select(F.col("best.doc_id").alias("k_id"), F.col("best.tie").alias("k_tie")).distinct(), "simhash-kept")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie"))
    return row.join(kept, same, "left_semi").dropDuplicates(["doc_id", "tie"]).select("row.*")
