"""Lookups in a table whose size is not known when the plan is written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.session import kept

#: Measured size up to which a lookup is sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Copies of a lookup beyond that size, and so tasks that rows of one key are spread over at least.
SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """About what the rows take, by their JSON text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def lookup_join(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join `big` with a `lookup` that has one row per key and is expected to be small.

    The lookup is evaluated once, into a written table, and its bytes are measured. Up to
    `limit` it is broadcast, and `big` is not shuffled. Beyond that, both sides are
    shuffled with the key salted, and adaptive execution splits what is still large.
    """
    small = kept(lookup, "lookup")
    if measured_bytes(small) <= limit:
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(big)), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    """Columns that xxhash64 accepts (maps are not)."""
    return [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]


# Rows of one join key that a single task may get.
HOT_ROWS = 1_000_000
#: Hash values that rows are counted by before keys are. A task keeps a count for each of
#: them, however many keys there are.
HOT_HASHES = 1 << 14


def _key_hash(on: Sequence[str], side: int = 0) -> Column:
    """One of `HOT_HASHES` values of the key; those of different sides differ."""
    return F.pmod(F.xxhash64(*on), F.lit(HOT_HASHES)) + side * HOT_HASHES


def _full_hashes(hashes: DataFrame, limit: int) -> list[int]:
    """The values of column ``_hash`` with more than `limit` rows: `HOT_HASHES` a side at most."""
    counts = hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    return [row["_hash"] for row in counts.where(F.col("_n") > limit).select("_hash").collect()]


def _counted(rows: DataFrame, on: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than `limit` rows in a written table, or None: the rows of each key are counted."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    found = kept(counts.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot-keys")
    return None if found.isEmpty() else found


def hot_keys(rows: DataFrame, on: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """All keys with more than `hot_rows` rows and the number of parts to cut each into.

    Reads the key columns only and counts before the shuffle. Rows are counted by a hash
    of their key first: where no hash has more than `hot_rows` rows, no key has, and of
    the others only the keys with such a hash are counted by themselves. The result is a
    written table, or None if no key is hot.
    """
    limit = hot_rows or HOT_ROWS
    full = _full_hashes(rows.select(_key_hash(on).alias("_hash")), limit)
    return _counted(rows.where(_key_hash(on).isin(full)), on, limit) if full else None


def hot_values(sides: Sequence[tuple[DataFrame, str]], hot_rows: int | None = None) -> list[DataFrame | None]:
    """`hot_keys` for several ``(rows, column)`` of one type, counted together.

    Each set of rows is read once for all its columns; only sides that may hold a hot key
    are looked at again.
    """
    limit = hot_rows or HOT_ROWS
    tables = {id(rows): rows for rows, _ in sides}
    hashes = [
        rows.select(F.explode(F.array(*[_key_hash([c], i) for i, (r, c) in enumerate(sides) if r is rows])).alias("_hash"))
        for rows in tables.values()
    ]
    full = _full_hashes(reduce(DataFrame.unionByName, hashes), limit)
    keys = [
        rows.where(_key_hash([column], i).isin(own)).select(F.lit(i).alias("_side"), F.col(column).alias("_key"))
        for i, (rows, column) in enumerate(sides)
        if (own := [value for value in full if value // HOT_HASHES == i])
    ]
    found = _counted(reduce(DataFrame.unionByName, keys), ["_side", "_key"], limit) if keys else None
    if found is None:
        return [None] * len(sides)
    split = []
    for i, (_, column) in enumerate(sides):
        own = found.where(F.col("_side") == i).select(F.col("_key").alias(column), "_parts")
        split.append(None if own.isEmpty() else own)
    return split


def hot_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join in which single keys may hold a large share of the rows of `many`.

    Adaptive execution splits such keys only where both sides come straight from a
    shuffle; this works anywhere in a chain of joins. Rows of a hot key are spread over
    as many parts as it needs, and the matching rows of `one`, few per key, are copied to
    each. Other keys keep one part. ``how="keep"`` also keeps the rows of `one` without
    a match. Columns come as those of `one`, then the new ones of `many`.
    """
    on = list(on)
    new = [c for c in many.columns if c not in one.columns]
    shown = [*one.columns, *new]
    if hot is None:
        return one.join(many, on, "left" if how == "keep" else "inner").select(*shown)
    parts = F.coalesce("_parts", F.lit(1))
    # a written table: small ones are broadcast by their measured size, others joined by a shuffle
    spread = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*_hashable(many)), parts).cast("int"))
    copied = one.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    matched = copied.drop("_parts").join(spread.drop("_parts"), [*on, "_part"]).select(*shown)
    if how != "keep":
        return matched
    unmatched = one.join(many.select(*on).distinct(), on, "left_anti")
    blank = {c: F.lit(None).cast(many.schema[c].dataType) for c in new}
    return matched.unionByName(unmatched.withColumns(blank).select(*shown))
