import pytest
from conftest import as_set
from pyspark.sql import functions as F

from trilake.operators import graphs
from trilake.operators.patterns import V, bgp, pattern
from trilake.operators.validate import validate_counts
from trilake.session import scratch_dir
from trilake.sources import store
from trilake.vocab import NS, TRIPLE_COLUMNS

A = [(":a", ":p", ":x"), (":b", ":p", ":x"), (":a", ":q", '"1"^^xsd:integer'), (":a", "http://other/p", ":y")]
B = [(":a", ":p", ":x"), (":c", ":p", ":z")]


def test_union_is_a_set_and_idempotent(graph_of):
    both = graphs.graph_union(graph_of(A), graph_of(B), graph_of(A))
    assert both.count() == 5 and graphs.graph_union(both, both).count() == 5


def test_clear_after_load_is_identity(graph_of):
    start = graph_of(A)
    loaded = graphs.load_into(graph_of(B + B), "http://g", into=start)
    assert as_set(graphs.graph_sizes(loaded)) == {(None, 4), ("http://g", 2)}
    assert tuple(graphs.store_size(loaded).first()) == (2, 6)
    assert as_set(graphs.clear_graph(loaded, "http://g")) == as_set(start)
    assert as_set(graphs.dump_graph(loaded)) == as_set(start)
    assert graphs.clear_graph(loaded, None).count() == 2
    replaced = graphs.replace_graph(loaded, "http://g", graph_of(A))
    assert as_set(graphs.graph_sizes(replaced)) == {(None, 4), ("http://g", 4)}


def test_store_prunes_by_predicate(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    store.persist_graph(graph_of(A), path)
    opened = store.open_graph(spark, path)
    assert as_set(opened.select(*TRIPLE_COLUMNS)) == as_set(graph_of(A))
    scan = pattern(opened, V("s"), ":p", V("o"))
    assert scan.count() == 2  # http://other/p shares the directory, not the IRI
    assert "PartitionFilters: [isnotnull(p_local" in scan._jdf.queryExecution().toString()
    star = bgp(opened, [(V("s"), ":p", V("o")), (V("s"), ":q", V("n", "int"))], strategy="star", single_valued=[":p", ":q"])
    assert [tuple(r) for r in star.collect()] == [(NS + "a", NS + "x", 1)]


def test_store_with_hash_directories(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    rows = [(":s", f":p{i}", ":o") for i in range(20)]
    store.persist_graph(graph_of(rows), path, layout="hash")
    opened = store.open_graph(spark, path)
    assert "p_bucket" in opened.columns and opened.count() == 20
    scan = pattern(opened, V("s"), ":p7", V("o"))
    assert scan.count() == 1 and "PartitionFilters: [isnotnull(p_bucket" in scan._jdf.queryExecution().toString()


def test_stored_graphs_are_replaced_one_at_a_time(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    both = graph_of(A).unionByName(graph_of(B, "http://g"))
    store.persist_graph(both, path, by_graph=True)
    store.replace_stored_graph(graph_of([(":n", ":r", ":m")]), path, "http://g")
    opened = store.open_graph(spark, path)
    assert as_set(graphs.graph_sizes(opened)) == {(None, 4), ("http://g", 1)}
    assert graphs.dump_graph(opened, "http://g").first().s == NS + "n"
    store.clear_stored_graph(spark, path, None)
    assert as_set(graphs.graph_sizes(store.open_graph(spark, path))) == {("http://g", 1)}


def test_validate_counts(spark, graph_of):
    loaded = graph_of(A).unionByName(graph_of(B, "http://g"))
    expected = spark.createDataFrame([(None, 4), ("http://g", 3), ("http://none", 1)], "g string, expected bigint")
    assert as_set(validate_counts(loaded, expected)) == {
        (None, 4, 4, True), ("http://g", 3, 2, False), ("http://none", 1, 0, False),
    }
    assert validate_counts(loaded, expected, 0.6).where("ok").count() == 2


def test_scratch_dir_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second and (not base or first.startswith(base))


def test_append_is_a_union_of_sets(spark, tmp_path, graph_of):
    for layout in ("predicate", "hash"):
        path = str(tmp_path / layout)
        store.persist_graph(graph_of(A), path, "append", layout=layout)
        for rows in (A, B + B, [(":a", ":p", '"x"'), (":new", ":r", ":x")], []):
            store.persist_graph(graph_of(rows), path, "append")
        opened = store.open_graph(spark, path)
        assert as_set(opened.select(*TRIPLE_COLUMNS)) == as_set(graphs.graph_union(graph_of(A + B), graph_of([(":a", ":p", '"x"'), (":new", ":r", ":x")])))
        assert opened.count() == 7
        store.vacuum_store(spark, path)
        assert store.open_graph(spark, path).count() == 7
        store.persist_graph(graph_of(B), path)
        store.vacuum_store(spark, path)
        assert store.open_graph(spark, path).count() == 2 and len(list((tmp_path / layout).glob("version=*"))) == 1


def test_append_reads_touched_predicates_only(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    store.persist_graph(graph_of(A), path)
    gone = next((tmp_path / "store").glob("version=*/p_local=p_q"))
    for file in gone.iterdir():
        file.write_bytes(b"no parquet") if not file.name.startswith(".") else file.unlink()
    store.persist_graph(graph_of(B), path, "append")
    assert pattern(store.open_graph(spark, path), V("s"), ":p", V("o")).count() == 3


def test_a_job_that_dies_leaves_the_old_graph(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    both = graph_of(A).unionByName(graph_of(B, "http://g"))
    store.persist_graph(both, path, by_graph=True)
    before = store.open_graph(spark, path)
    dies = graph_of(B * 50).withColumn("s", F.when(F.col("o") == NS + "z", F.raise_error(F.lit("died"))).otherwise(F.col("s")))
    for change in (
        lambda: store.persist_graph(dies, path, by_graph=True),
        lambda: store.persist_graph(dies, path, "append"),
        lambda: store.replace_stored_graph(dies, path, None),
    ):
        with pytest.raises(Exception, match="died"):
            change()
        assert as_set(store.open_graph(spark, path)) == as_set(before)
    store.clear_stored_graph(spark, path, "http://g")
    assert before.count() == 6 and store.open_graph(spark, path).count() == 4  # an open graph stays what it was
    with pytest.raises(ValueError, match="no graph"):
        store.open_graph(spark, str(tmp_path / "nothing"))


def test_two_changes_of_one_state_are_not_both_made(spark, tmp_path, graph_of):
    path = str(tmp_path / "store")
    store.persist_graph(graph_of(A), path)
    content = {"layout": "predicate", "by_graph": False, "parts": []}
    store._publish(spark, path, 1, content)
    with pytest.raises(RuntimeError, match="another job"):
        store._publish(spark, path, 1, content)
    assert store.open_graph(spark, path).count() == 0


def test_directories_of_odd_names(spark):
    names = ["http://a/plain_1", "http://a/x-y.z", "http://a/", "http://a/\u00e9\n", "http://a/end\n", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", store.local_part(F.col("p")).alias("part"))
    assert [r.part for r in rows.collect()] == ["p_plain_1", "p_x_y_z", "p_", "p___", "p_end_", None]
    # plain names, nearly all, are not rewritten
    assert "RLIKE" in rows._jdf.queryExecution().optimizedPlan().toString()
