import json

from conftest import as_set
from pyspark.sql import functions as F

from trilake.operators import measures as m
from trilake.sinks.results import report_rows, to_sparql_json, write_results
from trilake.sources.results import read_results, read_results_lines

LOG = "framework string, scale string, operation string, seconds string"


def record(framework, scale, operation, seconds):
    return {"framework": framework, "scale": scale, "operation": operation, "seconds": seconds}


def test_files_are_read_and_the_last_write_wins(spark, tmp_path):
    (tmp_path / "results_a.json").write_text(
        json.dumps([record("x", "medium", "read_turtle", 1.25), record("x", "medium", "read_turtle", 2.5),
                    record("y", "large", "query_q1_count", "TIMEOUT"), record("y", "large", "unknown", 1)], indent=2)
    )
    (tmp_path / "results_b.json").write_text(json.dumps([record("x", "large", "read_turtle", None), record("y", "large", "query_q1_count", 0.123456789)]))
    (tmp_path / "other.json").write_text(json.dumps([record("z", "medium", "read_turtle", 1)]))
    log = read_results(spark, str(tmp_path))
    latest = m.latest_per_key(log)
    assert as_set(latest.select("framework", "scale", "operation", "seconds")) == {
        ("x", "medium", "read_turtle", "2.5"), ("x", "large", "read_turtle", None),
        ("y", "large", "query_q1_count", "0.123456789"), ("y", "large", "unknown", "1"),
    }
    cleaned = m.clean_sentinels(m.map_operations(latest))
    wide = m.pivot_results(m.complete_grid(cleaned))
    assert wide.count() == 6
    rows = {(r.framework, r.scale): json.loads(r.json) for r in report_rows(wide, wide.columns[2:]).collect()}
    assert rows["x", "medium"]["read_turtle"] == 2.5 and rows["x", "medium"]["q1"] is None
    assert rows["y", "large"]["q1"] == 0.12346 and len(rows["y", "xlarge"]) == 8


def log_of(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_best_of_runs_ignores_what_is_no_number(spark):
    log = log_of(spark, ("a", "m", "q", "3"), ("a", "m", "q", "2.5"), ("a", "m", "q", "TIMEOUT"), ("b", "m", "q", "ERROR"))
    assert as_set(m.best_of_runs(log)) == {("a", "m", "q", 2.5), ("b", "m", "q", None)}


def test_grid_keeps_every_row_of_the_log(spark):
    log = log_of(spark, ("a", "m", "q1", "1"), ("a", "m", "q1", "2"), ("a", "odd", "q1", "3"))
    grid = m.complete_grid(log, ["m", "l"], ["q1", "q2"])
    assert sorted(map(tuple, grid.collect()), key=str) == sorted(
        [("a", "m", "q1", "1"), ("a", "m", "q1", "2"), ("a", "odd", "q1", "3"), ("a", "m", "q2", None),
         ("a", "l", "q1", None), ("a", "l", "q2", None)], key=str)
    filled = m.fill_skipped(log, {"q1": "TIMEOUT", "q2": "N/A"}, scales=["m"])
    assert ("a", "m", "q2", "N/A") in as_set(filled) and filled.count() == 4


def test_mark_failed_touches_reads_only(spark):
    log = log_of(spark, ("a", "m", "read_turtle", "1"), ("a", "m", "query_q1_count", "1"), ("a", "l", "read_turtle", "1"))
    failed = spark.createDataFrame([("a", "m"), ("a", "m")], "framework string, scale string")
    assert [tuple(r) for r in m.mark_failed(log, failed).orderBy("operation", "scale").collect()] == [
        ("a", "m", "query_q1_count", "1"), ("a", "l", "read_turtle", "1"), ("a", "m", "read_turtle", "FAILED"),
    ]


def test_order_and_membership(spark):
    log = log_of(spark, ("b", "l", "q2", "1"), ("a", "m", "q1", "1"), ("b", "m", "q2", "1"), ("c", "m", "q1", "1"))
    known = m.filter_known(log, ["a", "b"])
    ordered = m.enumerated_order(known, ["b", "a"], ["m", "l"], ["q2", "q1"]).collect()
    assert [(r.framework, r.scale) for r in ordered] == [("b", "m"), ("b", "l"), ("a", "m")]


def test_written_log_reads_back(spark, tmp_path):
    log = log_of(spark, ("a", "m", "q", "1.50"), ("a", "m", "q", None))
    write_results(log, str(tmp_path / "log"))
    assert as_set(read_results_lines(spark, str(tmp_path / "log"))) == as_set(log)


def test_bindings_as_json(spark):
    df = spark.createDataFrame([("http://b/x", 1, 'a "q"'), ("_:b", None, None)], "s string, n int, t string").coalesce(1)
    rows = [json.loads(r.value) for r in to_sparql_json(df, ["s"]).collect()]
    assert rows[0]["s"] == {"type": "uri", "value": "http://b/x"}
    assert rows[0]["n"] == {"type": "literal", "value": "1", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}
    assert rows[0]["t"] == {"type": "literal", "value": 'a "q"'}
    assert rows[1] == {"s": {"type": "bnode", "value": "_:b"}}
    assert to_sparql_json(df.select(F.col("n").cast("decimal(4,1)"))).first().value.count("decimal") == 1
