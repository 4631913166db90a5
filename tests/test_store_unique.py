import os

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from trilake.functions import terms
from trilake.sources import store

A = [("<http://a/1>", ":code", '"x"'), ("<http://a/2>", ":code", '"y"'), ("<http://a/1>", ":name", '"n"'), ("<http://a/2>", ":name", '"n"')]


def versions(path):
    return [n for n in os.listdir(path) if n.startswith("version=")]


@pytest.mark.parametrize("layout", ["predicate", "hash"])
def test_a_load_that_breaks_uniqueness_changes_nothing(spark, tmp_path, graph_of, layout):
    path = str(tmp_path / "store")
    store.persist_graph(graph_of(A), path, layout=layout, unique=[":code"])
    before, held = as_set(store.open_graph(spark, path)), versions(path)
    for bad in ([("<http://a/3>", ":code", '"x"')], [("<http://a/3>", ":code", '"z"'), ("<http://a/4>", ":code", '"z"')]):
        with pytest.raises(store.UniquenessError):
            store.persist_graph(graph_of(bad + [("<http://a/3>", ":name", '"m"')]), path, "append")
        assert as_set(store.open_graph(spark, path)) == before
        assert versions(path) == held
    good = [("<http://a/3>", ":code", '"x"^^<http://a/type>'), ("<http://a/1>", ":code", '"x"'), ("<http://a/3>", ":name", '"n"'), ("<http://a/1>", ":code", '"w"')]
    store.persist_graph(graph_of(good), path, "append")
    assert store.open_graph(spark, path).count() == len(A) + 3


def test_a_first_load_is_held_to_it_too(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    with pytest.raises(store.UniquenessError):
        store.persist_graph(graph_of(A), path, unique=[":name"])
    with pytest.raises(ValueError, match="no graph"):
        store.open_graph(spark, path)


def test_uniqueness_holds_within_a_graph(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    store.persist_graph(graph_of(A, "g:1").unionByName(graph_of(A)), path, by_graph=True, unique=[":code"])
    other = [("<http://b/1>", ":code", '"x"')]
    store.persist_graph(graph_of(other, "g:2"), path, "append")
    with pytest.raises(store.UniquenessError):
        store.persist_graph(graph_of(other, "g:1"), path, "append")
    store.replace_stored_graph(graph_of(other), path, "g:1")
    with pytest.raises(store.UniquenessError):
        store.replace_stored_graph(graph_of(other + A), path, "g:1")
    assert store.open_graph(spark, path).count() == len(A) + 2


def test_row_groups_are_pruned_by_object(spark, tmp_path):
    """Objects lie anywhere in their directory, so only a filter can tell where one is."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("s:"), F.col("id").cast("string")).alias("s"),
        F.lit(terms.iri(":code")).alias("p"),
        F.md5(F.col("id").cast("string")).alias("o"),
        F.lit("literal").alias("o_kind"),
        *[F.lit(None).cast("string").alias(c) for c in ("o_dtype", "o_lang", "g")],
    )
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(1 << 19))
    try:
        store.persist_graph(rows, str(tmp_path / "store"))
    finally:
        conf.unset("parquet.block.size")
    wanted = rows.where("s = 's:777'").first().o
    found = store.open_graph(spark, str(tmp_path / "store")).where(F.col("p") == terms.iri(":code")).where(F.col("o") == wanted)
    assert [r.s for r in found.collect()] == ["s:777"]
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 200_000 / 4
