from conftest import as_set
from pyspark.sql import functions as F

from trilake.operators import joins
from trilake.operators.joins import hot_join, hot_keys, hot_values, lookup_join, measured_bytes


def tables(spark):
    big = spark.range(200).select((F.col("id") % 7).alias("k"), F.when(F.col("id") < 150, 3).otherwise(F.col("id")).alias("v"))
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k bigint, name string")
    return big, lookup


def test_lookup_join_is_the_same_either_way(spark):
    big, lookup = tables(spark)
    wanted = sorted(map(tuple, big.join(lookup, "k", "left").collect()), key=str)
    broadcast = lookup_join(big, lookup, ["k"])
    salted = lookup_join(big, lookup, ["k"], limit=2)
    assert "Broadcast" in broadcast._jdf.queryExecution().toString()
    assert "_salt" in salted._jdf.queryExecution().toString()
    for joined in (broadcast, salted):
        assert sorted(map(tuple, joined.collect()), key=str) == wanted


def test_measured_bytes(spark):
    assert measured_bytes(spark.range(0)) == 0
    assert 100 * len('{"id":1}') <= measured_bytes(spark.range(100)) < 100 * len('{"id":100}')


def test_hot_keys(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("k"))
    assert as_set(hot_keys(rows, ["k"], 25)) == {(1, 3)}
    assert hot_keys(rows, ["k"], 60) is None


def test_hot_join_is_the_same_as_a_join(spark):
    many = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    one = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = hot_keys(many, ["k"], 20)
    for how, plain in (("inner", "inner"), ("keep", "left")):
        wanted = as_set(one.join(many, "k", plain).select("k", "w", "v"))
        for keys in (hot, None):
            joined = hot_join(many, one, ["k"], keys, how)
            assert joined.columns == ["k", "w", "v"] and as_set(joined) == wanted
            assert joined.count() == len(wanted)


def test_hot_values_counts_each_side_on_its_own(spark):
    rows = spark.range(100).select(F.lit(1).alias("a"), F.when(F.col("id") < 60, 1).otherwise(F.col("id")).alias("b"))
    ids = spark.range(100)
    a, b, c = hot_values([(rows, "a"), (rows, "b"), (ids, "id")], 25)
    assert as_set(a) == {(1, 4)} and as_set(b) == {(1, 3)} and c is None
    assert hot_values([(ids, "id")], 25) == [None]


def test_rows_without_hot_keys_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    rows = spark.range(100).select(F.udf(count, "long")("id").alias("a"), (F.col("id") + 1).alias("b")).distinct()
    assert hot_values([(rows, "a"), (rows, "b")], 25) == [None, None]
    assert seen.value == 100


def test_hot_keys_where_hashes_are_full_of_other_keys(spark, monkeypatch):
    rows = spark.range(100).select(F.when(F.col("id") < 60, F.col("id") % 2).when(F.col("id") < 90, F.col("id")).alias("k"))
    for hashes in (1, 3, joins.HOT_HASHES):
        monkeypatch.setattr(joins, "HOT_HASHES", hashes)
        assert as_set(hot_keys(rows, ["k"], 25)) == {(0, 2), (1, 2)}
        assert hot_keys(rows, ["k"], 30) is None
        assert as_set(hot_keys(rows, ["k"], 9)) == {(0, 4), (1, 4), (None, 2)}
        a, b, c = hot_values([(rows, "k"), (spark.range(100), "id"), (rows.where("k < 2"), "k")], 9)
        assert as_set(a) == {(0, 4), (1, 4), (None, 2)} and b is None and as_set(c) == {(0, 4), (1, 4)}
