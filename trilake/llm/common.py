"""What several operators share: table access, words, stored tables, running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trilake.session import scratch_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one cell of a running total is meant to hold.
CELL_ROWS = 4_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BATCH = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there.

    It cuts the lineage and keeps an expensive column from being computed once for each
    later use; a lost executor costs nothing that is written.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, as texts may be very long."""
    spark.conf.set(ARROW_BYTES, str(ARROW_BATCH))


def map_texts(
    df: DataFrame, text: str, fn: Callable[[list[bytes]], list[tuple]], schema: StructType
) -> DataFrame:
    """`df` without its column `text` and with the columns of `schema`, one tuple of
    `fn` for each text in UTF-8; a null text comes as empty."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text]
    out = StructType([*df.select(*keep).schema.fields, *schema.fields])
    names = [f.name for f in out.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(schema)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = fn(texts_of(batch, text))
            added = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(list(v), t) for v, t in zip(added, types)], names
            )

    return df.mapInArrow(batches, out)


def filter_texts(df: DataFrame, text: str, keeps: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of `df` whose text `keeps` accepts, all columns as they are."""
    small_batches(df.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array(keeps(texts_of(batch, text)), pa.bool_()))

    return df.mapInArrow(batches, df.schema)


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(text))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def unit_interval(md5_hex: Column) -> Column:
    """The first 32 bits of a hex digest as a number from 0 to below 1."""
    return F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def running_total(
    df: DataFrame, key: str, rows: str, place: Column, order: list, value: Column, out: str
) -> DataFrame:
    """`df` with `out`: the sum of `value` over the earlier rows of the same `key`.

    `place` (0 to below 1) must grow with `order`; `rows` is the number of rows of the
    key. A key is cut along `place` into cells of about ``CELL_ROWS`` rows; only the
    cells' sums are ordered within a key, so a key with a third of all rows is spread
    over as many tasks as it needs. `df` is read twice: hand in a stored table.
    """
    cells = F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(CELL_ROWS)))
    celled = df.withColumn("_cell", F.floor(place * cells)).withColumn("_value", value)
    sums = celled.groupBy(key, "_cell").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_cell", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy(key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.join(starts, [key, "_cell"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(before), F.lit(0)))
        .drop("_cell", "_value", "_start")
    )
