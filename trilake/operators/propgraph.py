"""Property-graph view of triples: nodes with labels and properties, typed edges.

Literals become properties, IRI-valued triples become edges, ``rdf:type`` becomes a
label; all names are local names. A property has one value per node: of several, the
greatest is kept. Language tags and datatypes are dropped.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions.terms import local_name
from trilake.operators.joins import hot_join, hot_values
from trilake.sources.store import local_name_filter
from trilake.vocab import RDF_TYPE

TYPE_NAME = "type"  # local name of rdf:type


def _facts(triples: DataFrame, edges_as_props: Sequence[str], keys: Collection[str] | None) -> DataFrame:
    """Rows ``(uri, label, key, value)``: what each triple says about its nodes."""
    name = local_name(F.col("p"))
    is_type = F.col("p") == RDF_TYPE
    linked = (F.col("o_kind") != "literal") & ~is_type
    as_prop = (F.col("o_kind") == "literal") | (linked & name.isin(*edges_as_props) if edges_as_props else F.lit(False))
    wanted = as_prop & name.isin(*keys) if keys is not None else as_prop
    null = F.lit(None).cast("string")

    def fact(uri: Column, label: Column, key: Column, value: Column) -> Column:
        return F.struct(uri.alias("uri"), label.alias("label"), key.alias("key"), value.alias("value"))

    about_subject = fact(
        F.col("s"),
        F.when(is_type, local_name(F.col("o"))),
        F.when(wanted, name),
        F.when(wanted, F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(local_name(F.col("o")))),
    )
    if keys is not None:
        # Only nodes with a label or one of the keys are asked for.
        named = triples.where(local_name_filter(triples, [*keys, TYPE_NAME]))
        return named.where(is_type | wanted).select(F.inline(F.array(about_subject)))
    # Ends of edges are only named: they are combined by themselves, which takes no sort.
    linked = F.coalesce(linked, F.lit(False))
    ends = triples.where(linked).select(F.explode(F.array("s", "o")).alias("uri")).distinct()
    named = ends.select("uri", *[null.alias(c) for c in ("label", "key", "value")])
    return triples.where(~linked | as_prop).select(F.inline(F.array(about_subject))).unionByName(named)


def labelled(triples: DataFrame, label: str) -> DataFrame:
    """Rows ``(uri)``: nodes that carry `label`; reads type statements only."""
    typed = triples.where(local_name_filter(triples, [TYPE_NAME])).where(F.col("p") == RDF_TYPE)
    return typed.where(local_name(F.col("o")) == label).select(F.col("s").alias("uri")).distinct()


def property_values(triples: DataFrame, key: str, edges_as_props: Collection[str] = ()) -> DataFrame:
    """Rows ``(uri, value)``: the nodes on which property `key` is set, with its greatest
    value; reads the statements of that key only. See `to_nodes` for `edges_as_props`."""
    literal = F.col("o_kind") == "literal"
    wanted = literal | (F.col("p") != RDF_TYPE) if key in edges_as_props else literal
    value = F.when(literal, F.col("o")).otherwise(local_name(F.col("o")))
    found = triples.where(local_name_filter(triples, [key])).where(wanted)
    return found.groupBy(F.col("s").alias("uri")).agg(F.max(value).alias("value"))


def count_nodes(triples: DataFrame) -> DataFrame:
    """One row ``count``: resources that are not just a class, without gathering their properties."""
    linked = (F.col("o_kind") != "literal") & (F.col("p") != RDF_TYPE)
    ends = F.when(linked, F.array("s", "o")).otherwise(F.array("s"))
    return triples.select(F.explode(ends).alias("uri")).distinct().agg(F.count(F.lit(1)).alias("count"))


def schema_of(triples: DataFrame) -> DataFrame:
    """Rows ``(kind, names array)``: every label, property key and relationship type in
    use, from one pass over the triples; names are combined before their shuffle."""
    is_type, literal = F.col("p") == RDF_TYPE, F.col("o_kind") == "literal"
    kind = F.when(literal, "property").when(is_type, "label").otherwise("relationship")
    name = F.when(is_type & ~literal, local_name(F.col("o"))).otherwise(local_name(F.col("p")))
    names = triples.select(kind.alias("kind"), name.alias("name")).distinct()
    return names.groupBy("kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def overwrite_multival(triples: DataFrame) -> DataFrame:
    """Rows ``(uri, key, value)``: one value per node and literal property, the greatest."""
    literals = triples.where(F.col("o_kind") == "literal")
    return literals.groupBy(F.col("s").alias("uri"), local_name(F.col("p")).alias("key")).agg(F.max("o").alias("value"))


def to_nodes(
    triples: DataFrame, edges_as_props: Sequence[str] = (), keys: Collection[str] | None = None
) -> DataFrame:
    """Rows ``(uri, labels array, props map)``, one per resource that is not just a class.

    `edges_as_props` names IRI-valued predicates that also become text properties (the
    local name of their object). With `keys`, only those properties are gathered and
    nodes that have neither a label nor one of them are left out; the filter reaches
    the scan.

    Ends of edges are combined before their shuffle, so a node that very many edges point
    to stays small. Then what is said of a node meets once: first one row per (node, label
    or key), then one row per node, in the same tasks.
    """
    facts = _facts(triples, edges_as_props, keys).repartition("uri")
    # IRIs start alike: rows are told apart by a hash first, which makes sorting them cheap.
    hashed = facts.withColumn("hash", F.xxhash64("uri"))
    single = hashed.groupBy("hash", "uri", "label", "key").agg(F.max("value").alias("value"))
    entry = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    nodes = single.groupBy("hash", "uri").agg(
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("props"),
    )
    return nodes.drop("hash")


def to_edges(triples: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Rows ``(src, type, dst)`` for IRI-valued triples; `types` narrows the scan."""
    linked = triples.where((F.col("o_kind") != "literal") & (F.col("p") != RDF_TYPE))
    if types:
        linked = linked.where(local_name_filter(triples, types))
    return linked.select(F.col("s").alias("src"), local_name(F.col("p")).alias("type"), F.col("o").alias("dst"))


def prop(key: str, as_type: str | None = None) -> Column:
    """Property of a node, null when absent (or malformed for `as_type`)."""
    value = F.try_element_at("props", F.lit(key))
    return value.try_cast(as_type) if as_type else value


def label_scan(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes that carry `label`."""
    return nodes.where(F.array_contains("labels", label))


def has_props(nodes: DataFrame, *keys: str) -> DataFrame:
    """Nodes on which every one of `keys` is set."""
    kept = nodes
    for key in keys:
        kept = kept.where(prop(key).isNotNull())
    return kept


def prop_equals(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return nodes.where(prop(key) == value)


def expand(edges: DataFrame, edge_type: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source)-[:edge_type]->(target)``.

    `sources` and `targets` are already filtered and projected node tables with their
    keys in columns ``src`` and ``dst``; all their columns are kept. Nodes with very many
    edges, at either end, are spread over several tasks.
    """
    typed = edges.where(F.col("type") == edge_type).select("src", "dst")
    hot_sources, hot_targets = hot_values([(typed, "src"), (typed, "dst")])
    leaving = hot_join(typed, sources, ["src"], hot_sources)
    return hot_join(leaving, targets, ["dst"], hot_targets)


def node_count(nodes: DataFrame) -> DataFrame:
    """One row ``count``: nodes, not triples."""
    return nodes.agg(F.count(F.lit(1)).alias("count"))


def schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(kind, name)``: every label, property key and relationship type in use."""
    labels = nodes.select(F.lit("label").alias("kind"), F.explode("labels").alias("name"))
    keys = nodes.select(F.lit("property").alias("kind"), F.explode(F.map_keys("props")).alias("name"))
    types = edges.select(F.lit("relationship").alias("kind"), F.col("type").alias("name"))
    return labels.unionByName(keys).unionByName(types).distinct()


def schema_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(kind, names array)``; the lists are distinct names, so they are short."""
    return schema(nodes, edges).groupBy("kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def sample_nodes(nodes: DataFrame, n: int = 3) -> DataFrame:
    """Labels and property keys of any `n` nodes."""
    return nodes.select("labels", F.array_sort(F.map_keys("props")).alias("keys")).limit(n)


def uniqueness_violations(df: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, count)`` for every value of `key` that occurs more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
