"""Graphs compared up to the names of their blank nodes.

Blank nodes are coloured by what stands around them: a node's next colour is made of its
colour and of the multiset of its triples, with the colours of the blank nodes in those.
Rounds go on until no colour is split any more. A multiset is kept as sums of hashes, so
a round is one join and one aggregation that combines before its shuffle, whatever the
number of triples of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.session import kept
from trilake.vocab import TRIPLE_COLUMNS

_FIRST = "0"
LOW = (1 << 32) - 1


def _is_bnode(c: Column) -> Column:
    return c.startswith("_:")


def _sides(triples: DataFrame) -> DataFrame:
    """Each blank node with each of its triples: ``(node, fixed, other)``.

    `fixed` is what names can not change, `other` the blank node at the other end, if any.
    """
    s_blank, o_blank = _is_bnode(F.col("s")), F.col("o_kind") == "bnode"
    end = F.struct("o", "o_kind", "o_dtype", "o_lang")
    as_subject = F.struct(
        F.col("s").alias("node"),
        F.xxhash64(F.lit("s"), "p", "g", F.when(~o_blank, F.to_json(end))).alias("fixed"),
        F.when(o_blank, F.col("o")).alias("other"),
    )
    as_object = F.struct(
        F.col("o").alias("node"),
        F.xxhash64(F.lit("o"), "p", "g", F.when(~s_blank, F.col("s"))).alias("fixed"),
        F.when(s_blank, F.col("s")).alias("other"),
    )
    sides = F.array_compact(F.array(F.when(s_blank, as_subject), F.when(o_blank, as_object)))
    return triples.where(s_blank | o_blank).select(F.inline(sides))


def bnode_colours(triples: DataFrame) -> DataFrame:
    """``(node, colour)`` for each blank node; equal graphs give equal colours.

    Colours do not depend on labels, files or partitioning. Nodes that refinement can not
    tell apart share a colour. The number of rounds is that of the longest way over blank
    nodes that is needed to tell two of them apart; each is written to the shared folder.
    Repeated triples count once. Null labels are no blank nodes.
    """
    sides = kept(_sides(triples.select(*TRIPLE_COLUMNS).dropDuplicates()), "bnode-sides")
    colours = kept(sides.select("node").distinct().withColumn("colour", F.lit(_FIRST)), "bnode-colours")
    nodes, found = colours.count(), 1
    while True:
        known = colours.select(F.col("node").alias("other"), F.col("colour").alias("other_colour"))
        seen = sides.join(known, "other", "left")
        # two sums of 64-bit hashes, exact as each half is summed by itself
        hashes = seen.select("node", *[F.xxhash64(F.lit(i), "fixed", "other_colour").alias(f"h{i}") for i in (1, 2)])
        halves = {f"{h}_{n}": half for h in ("h1", "h2") for n, half in (("high", F.shiftright(h, 32)), ("low", F.col(h).bitwiseAND(LOW)))}
        sums = hashes.groupBy("node").agg(*[F.sum(half).alias(name) for name, half in halves.items()])
        new = F.md5(F.concat_ws(" ", "colour", *[F.col(name).cast("string") for name in halves]).cast("binary"))
        colours = kept(colours.join(sums, "node").select("node", new.alias("colour")), "bnode-colours")
        now = colours.select("colour").distinct().count()
        if now <= found or now == nodes:
            return colours
        found = now


def canonical_graph(triples: DataFrame) -> DataFrame:
    """The triples with blank nodes named ``_:c`` and their colour, and `n`, how many are alike.

    `n` is 1 where colours tell all blank nodes apart. A graph without blank nodes comes as it is.
    """
    colours = bnode_colours(triples)
    named = colours.select("node", F.concat(F.lit("_:c"), F.col("colour")).alias("name"))
    rows = triples.select(*TRIPLE_COLUMNS).dropDuplicates()
    for end, blank in (("s", _is_bnode(F.col("s"))), ("o", F.col("o_kind") == "bnode")):
        # only a blank node has a key to join on; rows without one stay where they are
        names = named.select(F.col("node").alias("_node"), F.col("name").alias("_name"))
        rows = rows.join(names, F.when(blank, F.col(end)) == F.col("_node"), "left")
        rows = rows.withColumn(end, F.coalesce("_name", end)).select(*TRIPLE_COLUMNS)
    return rows.groupBy(*TRIPLE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


def graph_differences(left: DataFrame, right: DataFrame, right_canonical: DataFrame | None = None) -> DataFrame:
    """Canonical triples that one graph has more often than the other: ``in_left``, ``in_right``.

    No rows: the graphs are equal up to the names of blank nodes, where colours tell all of
    these apart (`n` is 1 throughout); where not, they are equal as far as refinement sees.
    Where the `canonical_graph` of `right` is there already, it need not be found again.
    """
    named = [canonical_graph(left), canonical_graph(right) if right_canonical is None else right_canonical]
    counted = [g.select(*TRIPLE_COLUMNS, *[F.col("n") if i == j else F.lit(None).cast("bigint").alias("n") for j in (0, 1)]) for i, g in enumerate(named)]
    sides = [c.toDF(*TRIPLE_COLUMNS, "in_left", "in_right") for c in counted]
    none = F.lit(0).cast("bigint")
    sums = sides[0].unionByName(sides[1]).groupBy(*TRIPLE_COLUMNS)
    both = sums.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("in_left", "in_right")])
    return both.where("in_left <> in_right")
