"""Whole graphs: sizes, union, named graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilake.sources.store import graph_filter
from trilake.vocab import TRIPLE_COLUMNS


def as_triples(df: DataFrame) -> DataFrame:
    """Just the triple columns, without the partition columns of a store."""
    return df.select(*TRIPLE_COLUMNS)


def load_into(triples: DataFrame, graph: str, into: DataFrame | None = None) -> DataFrame:
    """Put triples into the named graph, next to what `into` holds already."""
    moved = as_triples(triples).withColumn("g", F.lit(graph))
    return moved.dropDuplicates() if into is None else graph_union(into, moved)


def graph_union(*graphs: DataFrame) -> DataFrame:
    """Union as sets of triples: a triple in several inputs occurs once.

    Rows are hashed on all their columns, so no key gathers rows in one task, and
    repeated rows of one task are dropped before the shuffle.
    """
    return reduce(DataFrame.unionByName, [as_triples(g) for g in graphs]).dropDuplicates()


def dump_graph(triples: DataFrame, graph: str | None = None) -> DataFrame:
    """The triples of one graph (default graph if None)."""
    return triples.where(graph_filter(triples, graph))


def clear_graph(triples: DataFrame, graph: str | None) -> DataFrame:
    """All triples but those of one graph."""
    return triples.where(~F.col("g").eqNullSafe(F.lit(graph).cast("string")))


def replace_graph(triples: DataFrame, graph: str | None, new: DataFrame) -> DataFrame:
    """The content of one graph exchanged for `new`."""
    kept = as_triples(clear_graph(triples, graph))
    fresh = as_triples(new).withColumn("g", F.lit(graph).cast("string")).dropDuplicates()
    return kept.unionByName(fresh)


def count_triples(triples: DataFrame) -> DataFrame:
    """One row ``count``."""
    return triples.agg(F.count(F.lit(1)).alias("count"))


def graph_sizes(triples: DataFrame) -> DataFrame:
    """Rows ``(g, triples)``, one per graph; ``g`` is null for the default graph."""
    return triples.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def store_size(triples: DataFrame) -> DataFrame:
    """One row: graphs and triples over all graphs."""
    return graph_sizes(triples).agg(
        F.count(F.lit(1)).alias("graphs"), F.coalesce(F.sum("triples"), F.lit(0)).cast("bigint").alias("triples")
    )
