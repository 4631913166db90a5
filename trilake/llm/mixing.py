"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

All of it is DataFrame work: word counts by an expression, targets by a closed form over
the per-source table, quotas by highest quotients, and a seeded order within each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilake.llm.common import WORD, n_words, running_total, stored, unit_interval

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SHARDS = 16
SEED = 42
#: Words of a block at most, and blocks that the smallest target is cut into at least.
MAX_BLOCK, LEAST_BLOCKS = 2_048, 200


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row for each source: rank, rows, source_size, weight, target, total.

    Sources by code point, null last, weigh `weights`, repeating. Targets share the size
    of all documents by weight; none is above `max_repeats` times its source's size, and
    what is cut off is shared again by weight. With sources by growing cap / weight, the
    common level is the greatest of (total - caps before) / (weights from here on).
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    first = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("cap").over(first), F.lit(0))
    return (
        sizes.groupBy("source")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", left.cast("double") / F.sum("weight").over(rest))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "rank", "rows", "source_size", "cap", "weight", "target", "total")
    )


def block_quotas(targets: DataFrame, shards=SHARDS) -> DataFrame:
    """`targets` with block (words in a block) and bounds: for each source, how many of
    its blocks the shards up to and with each one take.

    Sainte-Laguë: the h blocks of the first shards go to the h highest quotients
    target / (2k + 1), ties to the lower rank. A source's seats at house size h lie
    within those of the divisors total / (h -+ half the number of sources), so only
    about four quotients for each source and shard are compared.
    """
    everything = Window.partitionBy()
    positive = F.when(F.col("target") > 0, F.col("target"))
    t = targets.withColumn(
        "block",
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.min(positive).over(everything) / LEAST_BLOCKS))),
    ).withColumn("n", F.count(positive).over(everything))
    blocks = F.floor(F.col("total") / F.col("block") + 0.5)
    share = lambda h: F.col("target") * h / F.col("total") + 0.5
    houses = (
        t.where("target > 0")
        .select("rank", "target", "total", "n", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"), blocks.alias("blocks"))
        .withColumn("house", F.floor(F.col("blocks") * F.col("shard") / shards))
        .withColumn("sure", F.greatest(F.lit(0), F.floor(share(F.col("house") - F.col("n") / 2 - 1)) - 1).cast("long"))
        .withColumn("most", (F.floor(share(F.col("house") + F.col("n") / 2 + 1)) + 1).cast("long"))
    )
    order = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "rank", "k")
    sure = houses.groupBy("shard").agg(F.sum("sure").alias("given"))
    won = (
        houses.withColumn("k", F.explode(F.sequence("sure", "most")))
        .join(sure, "shard")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") + F.col("given") <= F.col("house"))
        .groupBy("shard", "rank")
        .agg(F.count("*").alias("won"))
    )
    bounds = (
        houses.join(won, ["shard", "rank"], "left")
        .groupBy("rank")
        .agg(F.array_sort(F.collect_list(F.col("sure") + F.coalesce("won", F.lit(0)))).alias("bounds"))
    )
    return t.drop("n").join(bounds, "rank", "left")


def _placed(rows: DataFrame, weights, max_repeats, shards) -> DataFrame:
    """`rows` (doc_id, source, size, key, tie) with its source's targets, the words it
    takes in whole passes and after them, and its start in the source's word stream."""
    quotas = stored(block_quotas(source_targets(rows, weights, max_repeats), shards), "mix-quotas")
    words = F.coalesce(F.element_at("bounds", -1), F.lit(0)) * F.col("block")
    # a null source is a source like others, so the key is the rank and not the name
    ranked = rows.join(
        quotas.select("rank", "rows", "source_size", "target", "block", "bounds", F.least("cap", words).alias("words"), F.col("source").alias("q_source")),
        F.col("source").eqNullSafe(F.col("q_source")),
    ).drop("q_source")
    order = ["key", "doc_id", "size", "tie"]
    return running_total(ranked, "rank", "rows", unit_interval(F.col("key")), order, F.col("size"), "start")


def _pass(p: int) -> Column:
    """Words taken of a document when its source's stream is read for the p-th time."""
    at = F.col("start") + p * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - at)).cast("long")


def _shard(p: int | Column) -> Column:
    """The shard whose quota holds the block in which a document's p-th reading starts."""
    at = F.floor((F.col("start") + p * F.col("source_size")) / F.col("block"))
    return F.size(F.filter("bounds", lambda bound: bound <= at))


def _keyed(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *more)


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS, shards=SHARDS, seed=SEED) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, block, shard.

    Each source's documents, in an order drawn from the seed and doc_id, are one cyclic
    stream of words. It is cut into equal blocks; the source gives the first blocks of
    it, as many as its quotas say, reading the stream again where the target is above
    its size, and never more than `max_repeats` times. No document is cut except the
    one at the end of what is taken.

    Shards 0 to `shards` - 1 take the blocks of each source in turn, as many as their
    integer quotas, so each shard has the sources in their target shares. A document
    belongs to the shard of the block in which it starts: `shard` is that of its first
    reading, null where nothing is taken; `mixed_documents` has that of each reading.

    Null text: size 0, takes 0. Null source: a source of its own, last. Null doc_id:
    ordered as an empty one. Repeated rows count each. Ties in the order go to doc_id,
    size and a hash of the text; rows equal in all are alike. An empty table gives none.
    """
    rows = stored(_keyed(docs, seed), "mix-sizes")
    taken = sum((_pass(p) for p in range(1, max_repeats)), _pass(0))
    return _placed(rows, weights, max_repeats, shards).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.col("block").cast("long").alias("block"),
        F.when(taken > 0, _shard(0)).alias("shard"),
    )


def mixed_documents(
    docs: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS, shards=SHARDS, seed=SEED, shard_column: str | None = None
) -> DataFrame:
    """The mix as documents: one row for each time that a document is read, in the columns of `docs`.

    With `shard_column`, also the shard that each reading belongs to, under that name; it
    may not be a column of `docs`.

    The document at the end of what a source gives is cut to the words taken, joined by
    spaces; all others are whole. Documents of which nothing is taken go. `n_chars`, where
    the table has it, follows a cut text. Cases as in `mix`.
    """
    columns = docs.columns
    if shard_column in columns:
        raise ValueError(f"the documents already have a column {shard_column!r}")
    rows = stored(_keyed(docs, seed, F.struct("*").alias("row")), "mix-rows")
    passes = F.array(*[_pass(p) for p in range(max_repeats)])
    taken = _placed(rows, weights, max_repeats, shards).select("*", F.posexplode(passes).alias("pass", "words_taken")).where("words_taken > 0")
    cut = F.col("words_taken") < F.col("size")
    piece = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("words_taken")).cast("int")), " ")
    taken = taken.withColumn("piece", F.when(cut, piece).otherwise(F.col("row.text")))
    shown = {"text": F.col("piece"), "n_chars": F.when(cut, F.length("piece").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    more = [_shard(F.col("pass")).alias(shard_column)] if shard_column else []
    return taken.select(*[shown[c].alias(c) if c in shown else F.col("row").getField(c).alias(c) for c in columns], *more)
