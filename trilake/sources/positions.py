"""Where a line stands in its file, for text that many tasks read.

A task reads a split from front to back, so the byte at which the split starts and the
order within the task put the lines of a file in order without reading it in one piece.
Line numbers need one more step: the lines before each split, a running sum over one row
for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilake.session import kept
from trilake.sources.ntriples import BNODE, IRI, LANG, LITERAL_BODY, STATEMENT

_BLANK = r"^\s*(?:#.*)?$"
_SUBJECT = rf"^[ \t]*(?:{IRI}|{BNODE})"
_PREDICATE = rf"{_SUBJECT}[ \t]*{IRI}"
_OBJECT = rf"{_PREDICATE}[ \t]*(?:{IRI}|{BNODE}|{LITERAL_BODY}(?:\^\^{IRI}|{LANG})?)"


def file_order() -> Column:
    """A value that grows from row to row of a file; only its order has a meaning.

    For rows straight from a scan of a splittable format. The same whatever the splits are.
    """
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def numbered(lines: DataFrame) -> DataFrame:
    """Rows with `file` and `pos` (a `file_order`) -> `line`, from 1 in each file, for `pos`.

    `lines` has all lines of its files and is read twice: hand in a written table, as the
    numbers in `pos` differ between scans that are split in different ways.
    """
    split = ["file", "block"]
    flat = lines.select("*", F.col("pos.block").alias("block"), F.col("pos.at").alias("at")).drop("pos")
    # the lines of a split are read by one task without others between them: `at` has no gaps
    splits = flat.groupBy(*split).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*split, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return flat.join(starts, split).withColumn("line", F.col("at") + F.col("shift")).drop("block", "at", "shift")


def ntriples_rejects(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """The lines that `read_ntriples` can not read: ``(file, line, reason, text)``.

    `reason` names the first part of the statement that is wrong: ``subject``,
    ``predicate``, ``object``, or ``end`` for what stands after a good object. The rows
    are as many as `load_stats` counts. Repeated lines come each at its place.
    """
    line = F.col("value")
    bad = ~line.rlike(_BLANK) & ~line.rlike(STATEMENT)
    read = spark.read.options(**options).text(path)
    marked = read.select(F.col("_metadata.file_path").alias("file"), file_order().alias("pos"), F.when(bad, line).alias("text"))
    text = F.col("text")
    reason = (
        F.when(~text.rlike(_SUBJECT), "subject")
        .when(~text.rlike(_PREDICATE), "predicate")
        .when(~text.rlike(_OBJECT), "object")
        .otherwise("end")
    )
    placed = numbered(kept(marked, "line-places"))
    return placed.where(text.isNotNull()).select("file", "line", reason.alias("reason"), "text")
