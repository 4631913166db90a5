"""Checks of a load against expected sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilake.operators.graphs import graph_sizes


def validate_counts(triples: DataFrame, expected: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """Rows ``(g, expected, triples, ok)`` for each graph of `expected` (``g``, ``expected``).

    A load is fine when it reached `tolerance` of what was expected; a graph that is
    missing has zero triples.
    """
    sizes = graph_sizes(triples).select(F.col("g").alias("_g"), "triples")
    wanted = expected.select("g", F.col("expected").cast("bigint"))
    # one row per graph on both sides; the default graph is null
    joined = wanted.join(sizes, F.col("g").eqNullSafe(F.col("_g")), "left")
    loaded = F.coalesce("triples", F.lit(0).cast("bigint"))
    floor = F.col("expected").cast("decimal(30,0)") * F.lit(str(tolerance)).cast("decimal(10,6)")
    return joined.select("g", "expected", loaded.alias("triples"), (loaded >= floor).alias("ok"))
