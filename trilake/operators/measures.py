"""Operators on a log of measurements ``(framework, scale, operation, seconds)``.

A log may hold a large share of its rows under one key, so everything per key is an
aggregation that combines before its shuffle; nothing is ranked within a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions.values import clean_seconds, mapped
from trilake.operators.joins import lookup_join
from trilake.vocab import OPERATIONS, SCALES

KEY = ["framework", "scale", "operation"]


def filter_known(log: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    return log.where(F.col("framework").isin(*frameworks))


def map_operations(log: DataFrame, operations: Mapping[str, str] = OPERATIONS) -> DataFrame:
    """Raw operation names -> report names; rows of unmapped operations go."""
    return log.withColumn("operation", mapped(F.col("operation"), operations)).where(F.col("operation").isNotNull())


def clean_sentinels(log: DataFrame, digits: int = 5) -> DataFrame:
    """`seconds` as a double: sentinels and unreadable text become null."""
    return log.withColumn("seconds", clean_seconds(F.col("seconds"), digits))


def latest_per_key(log: DataFrame, order: Sequence[str] = ("file", "pos"), key: Sequence[str] = KEY) -> DataFrame:
    """Last write wins: per key the row that is greatest by `order`."""
    rest = [c for c in log.columns if c not in key and c not in order]
    latest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*key, "_row.*")


def best_of_runs(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Shortest run per key; null when no run has a number."""
    return log.groupBy(*key).agg(F.min(F.col("seconds").try_cast("double")).alias("seconds"))


def pivot_results(log: DataFrame, operations: Sequence[str] = tuple(OPERATIONS.values())) -> DataFrame:
    """One row per (framework, scale), one column per operation.

    The input has one row per key; of several, the shortest counts.
    """
    return log.groupBy("framework", "scale").pivot("operation", list(operations)).agg(F.min("seconds"))


def complete_grid(
    log: DataFrame,
    scales: Sequence[str] = tuple(SCALES),
    operations: Sequence[str] = tuple(OPERATIONS.values()),
) -> DataFrame:
    """Add a null row for each scale and operation a framework of the log lacks.

    The log itself is not shuffled: its distinct keys are taken off the grid, and what
    is left of the grid is appended.
    """
    keys = log.select(*KEY).distinct()
    cells = (
        keys.select("framework")
        .distinct()
        .withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
        .withColumn("operation", F.explode(F.array(*[F.lit(o) for o in operations])))
    )
    missing = cells.join(keys, KEY, "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in log.schema.fields if f.name not in KEY}
    return log.unionByName(missing.withColumns(blank).select(*log.columns))


def fill_skipped(
    log: DataFrame,
    sentinels: Mapping[str, str],
    default: str = "TIMEOUT",
    scales: Sequence[str] = tuple(SCALES),
) -> DataFrame:
    """Complete the grid over the operations of `sentinels`, and show each missing value
    by its operation's sentinel."""
    full = complete_grid(log, scales, list(sentinels))
    return full.withColumn("seconds", F.coalesce("seconds", mapped(F.col("operation"), sentinels, default)))


def mark_failed(log: DataFrame, failed: DataFrame, prefix: str = "read_", sentinel: str = "FAILED") -> DataFrame:
    """Overwrite `seconds` of the operations starting with `prefix` for every
    (framework, scale) listed in `failed`."""
    flagged = failed.select("framework", "scale").distinct().withColumn("_failed", F.lit(True))
    joined = lookup_join(log, flagged, ["framework", "scale"])
    hit = F.coalesce("_failed", F.lit(False)) & F.col("operation").startswith(prefix)
    marked = joined.withColumn("seconds", F.when(hit, F.lit(sentinel)).otherwise(F.col("seconds")))
    return marked.select(*log.columns)


def listed_position(column: Column, listing: Sequence[str]) -> Column:
    """Place of a value in a listing, from 1; 0 for values that are not listed."""
    return F.array_position(F.array(*[F.lit(x) for x in listing]), column)


def enumerated_order(
    log: DataFrame,
    frameworks: Sequence[str],
    scales: Sequence[str] = tuple(SCALES),
    operations: Sequence[str] = tuple(OPERATIONS.values()),
) -> DataFrame:
    """Sort by the order in which the names are listed, others after them by name; then by
    all columns, so that equal names don't have to meet in one range of the sort."""
    named = (("framework", frameworks), ("scale", scales), ("operation", operations))
    keys = [k for name, listing in named for k in (listed_last(F.col(name), listing), F.col(name))]
    return log.orderBy(*keys, *[c for c in log.columns if c not in ("framework", "scale", "operation")])


def listed_last(column: Column, listing: Sequence[str]) -> Column:
    """Place of a value in a listing; values that are not listed come after all others."""
    place = listed_position(column, listing)
    return F.when(place > 0, place).otherwise(len(listing) + 1)
