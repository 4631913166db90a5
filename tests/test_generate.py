from conftest import as_set
from pyspark.sql import functions as F

from trilake.plans import ecommerce as ec
from trilake.sources.generate import entity_graph, generate_entities
from trilake.vocab import COUNTRIES, EXPECTED_TRIPLES


def test_sizes_domains_and_determinism(spark):
    customers, products, orders = generate_entities(spark, 1_000, 200, 13_000)
    graph = entity_graph(customers, products, orders)
    assert graph.count() == EXPECTED_TRIPLES["medium"] == graph.distinct().count()
    assert as_set(graph) == as_set(entity_graph(customers, products, orders, "branches"))
    assert as_set(customers) == as_set(generate_entities(spark, 1_000, 200, 13_000)[0].repartition(7))
    assert as_set(customers) != as_set(generate_entities(spark, 1_000, 200, 13_000, seed=1)[0])
    assert {r[0] for r in customers.select("country").distinct().collect()} == set(COUNTRIES)
    low, high, first, last = orders.agg(F.min("amount"), F.max("amount"), F.min("customer"), F.max("customer")).first()
    assert 50 <= low < 100 and 4_900 < high <= 5_000 and (first, last) == (0, 999)
    assert products.where("unit_price BETWEEN 29.99 AND 2999.99 AND stock_level BETWEEN 0 AND 500").count() == 200


def test_hash_reaches_large_domains(spark):
    from trilake.functions.values import seeded_hash

    ids = spark.range(100_000).select("id", seeded_hash(F.col("id"), 21).alias("h"), seeded_hash(F.col("id") + 2147483647, 21).alias("far"))
    low, high, equal = ids.agg(F.min("h"), F.max(F.col("h") % 1_000_000_000), F.count_if(F.col("h") == F.col("far"))).first()
    assert low >= 0 and high > 990_000_000 and equal < 5


def test_benchmark_queries_on_the_generated_graph(spark):
    graph = entity_graph(*generate_entities(spark, 200, 50, 2_000), "branches")
    assert ec.q2_customer_orders(graph).count() == 20
    norway = ec.q3_join_3_entities(graph).collect()
    assert len(norway) == 50 and [r.amount for r in norway] == sorted((r.amount for r in norway), reverse=True)
    totals = ec.q4_optional_aggregation(graph).agg(F.sum("customers"), F.sum("orders")).first()
    assert tuple(totals) == (200, 2_000)
