"""Resampling towards a target distribution: hashed n-gram features, Gumbel noise, exact top share."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from trilake.llm.common import map_texts, small_batches, stored

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SCALE = 1000
#: Relative accuracy of the quantile sketch, and the share of ranks a bracket reaches to each side.
ACCURACY, MARGIN = 10_000, 0.001
#: Rows of a bracket that one sort may get; a larger one is bracketed again.
BRACKET_ROWS = 4_000
#: Cells of scores in which drawn rows are ranked.
CELLS = 200
#: Bytes that belong to words, A-Z lower-cased, all others as spaces.
WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
FEATURES = StructType([StructField("n_words", LongType()), StructField("features", BinaryType())])


def features(raw: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, bytes]:
    """Number of words, and the bucket of each run of 1 to `longest` words (32-bit numbers).

    A run's checksum goes on from that of the run without its last word.
    """
    words = raw.translate(WORD_BYTES).split()
    sums = list(map(zlib.crc32, words))
    found = [np.array(sums, np.uint32)]
    spaced = [b" " + w for w in words]
    for n in range(1, longest):
        sums = list(map(zlib.crc32, spaced[n:], sums))
        found.append(np.array(sums, np.uint32))
    return len(words), (np.concatenate(found) % buckets).astype("<u4").tobytes()


def featured(docs: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    rows = docs.select(*keep, "text")
    return map_texts(rows, "text", lambda texts: [features(t, longest, buckets) for t in texts], FEATURES)


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column("features").to_pylist():
                sums += np.bincount(np.frombuffer(one, "<u4"), minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    counted = rows.select("features").mapInArrow(count, "bucket long, n long")
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled log ratio of the smoothed target and source shares of each bucket, rounded down."""
    n = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(scale * math.log(r)) for r in ratio], np.int64)


def noise(seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise of a document, from a digest of its id (null: no digits), rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of all rows, as a written table.

    Features are computed once and written down; gains are an array of ``BUCKETS`` numbers
    that every task looks buckets up in.
    """
    rows = stored(featured(docs, ["doc_id"]), "resampling-features")
    gain = gains(histogram(rows), histogram(featured(target, [])))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<u4") for f in batch.column("features").to_pylist()]
            added = [pa.array([len(f) for f in found], pa.int64()), pa.array([int(gain[f].sum()) for f in found], pa.int64())]
            kept = [batch.column("doc_id"), batch.column("n_words")]
            yield pa.RecordBatch.from_arrays(kept + added, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return stored(weighed.withColumn("score", F.col("weight") + noise(seed)), "resampling-scores")


def cutoff(rows: DataFrame, column: str, place: int, bracket_rows: int = BRACKET_ROWS) -> int | None:
    """The `place`-th highest value of a column of whole numbers (1: the highest).

    A quantile sketch gives a bracket around it. The exact number of rows above it and in
    it tells whether the value is inside; if not, the bracket is widened to the side that
    was missed. A bracket of more rows than `bracket_rows` is bracketed again; only what
    is left is grouped by value and sorted. None if there are fewer rows.
    """
    at = F.col(column)
    total, low, high = rows.agg(F.count(at), F.min(at), F.max(at)).first()
    if not 1 <= place <= total:
        return None
    above, inside = 0, total
    while inside > bracket_rows and low < high:
        part = rows.where(at.between(low, high))
        rank = 1 - (place - above) / inside
        margin = MARGIN
        while True:
            ends = [max(0.0, rank - margin), min(1.0, rank + margin)]
            a, b = part.agg(F.percentile_approx(at, F.array(*map(F.lit, ends)), ACCURACY)).first()[0]
            a, b = low if ends[0] == 0 else a, high if ends[1] == 1 else b
            over, within = part.agg(
                F.coalesce(F.sum((at > b).cast("long")), F.lit(0)), F.coalesce(F.sum(at.between(a, b).cast("long")), F.lit(0))
            ).first()
            if above + over < place <= above + over + within:
                break
            margin *= 4
        if (a, b) == (low, high):
            break  # one value holds nearly all: few values are left to sort
        low, high, above, inside = a, b, above + over, within
    values = rows.where(at.between(low, high)).groupBy(column).count()
    before = Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, 0)
    passed = values.withColumn("_passed", F.sum("count").over(before)).where(F.col("_passed") >= place - above)
    return passed.agg(F.max(column)).first()[0]


def ranked(rows: DataFrame, order: list[Column], by: str) -> DataFrame:
    """`rows` with `rank`: 1, 2, 3... in `order`, which starts with `by` descending.

    Equal rows are counted first and spread out last, so they never meet as rows. Rows are
    cut into ``CELLS`` cells along a quantile sketch of `by`; only cells' sums are ordered
    among each other.
    """
    at = F.col(by)
    counted = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies")), "resampling-drawn")
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    ends = counted.agg(F.percentile_approx(at, shares, ACCURACY)).first()[0] or []
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))).cast("array<long>"), lambda x: x > at))
    celled = counted.withColumn("_cell", cell)
    sums = celled.groupBy("_cell").agg(F.sum("_copies").alias("_n"))  # CELLS rows at most
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = celled.join(F.broadcast(starts), "_cell").withColumn(
        "_start", F.col("_start") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    )
    each = F.explode(F.sequence(F.col("_start") + 1, F.col("_start") + F.col("_copies")))
    return placed.select(*rows.columns, each.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of all rows.

    Of the documents with at least `min_words` words, the `percent` with the highest scores
    are drawn; ties go to the smaller doc_id (null last), then to fewer features. Which of
    several equal rows is drawn makes no difference. Null and empty texts have no words,
    no features and weight 0. An empty target smooths every bucket alike. No rows give
    none; other columns are ignored, also those with the names of the output.
    """
    small_batches(docs.sparkSession)
    rows = scored(docs, target, seed)
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    least = cutoff(able, "score", drawn)
    blank = F.lit(None).cast("long")
    if least is None:
        return rows.withColumn("rank", blank)
    leading = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")]
    first = ranked(rows.where(leading), order, "score")
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return rows.where(~leading).withColumn("rank", blank).unionByName(first)
