"""Loading one or many files into named graphs, and counting what was loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.sources.ntriples import read_ntriples
from trilake.sources.turtle import read_turtle
from trilake.vocab import TRIPLE_COLUMNS


def read_files(
    spark: SparkSession, directory: str, glob: str, graph: str | None = None, syntax: str = "ntriples"
) -> DataFrame:
    """Read the files of a directory whose names match `glob`."""
    if syntax == "ntriples":
        return read_ntriples(spark, directory, graph, pathGlobFilter=glob)
    if syntax == "turtle":
        return read_turtle(spark, directory, graph, pathGlobFilter=glob)
    raise ValueError(f"unknown syntax {syntax!r}")


def file_count(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """One row: how many non-empty files `read_files` would load. Lists, does not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return found.where(F.col("length") > 0).agg(F.count(F.lit(1)).alias("files"))


def load_stats(parsed: DataFrame) -> DataFrame:
    """One row ``(parsed, loaded, rejected)`` from `scan_ntriples` or `scan_turtle`.

    Statements read, distinct triples among them, and records that did not parse. One
    shuffle: equal rows are counted together first, so repeated ones cost little.
    """
    keys = [F.when(F.col("ok"), F.col(c)).alias(c) for c in TRIPLE_COLUMNS]
    counted = parsed.select(*keys, "ok").groupBy(*TRIPLE_COLUMNS, "ok").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    return counted.agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), none).alias("parsed"),
        F.count_if(F.col("ok")).alias("loaded"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), none).alias("rejected"),
    )
