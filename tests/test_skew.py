"""One customer with a third of all orders, one order with a third of all items."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from trilake.operators import joins
from trilake.plans import ecommerce as ec
from trilake.sources.generate import entity_graph, generate_entities
from trilake.sources.tables import Template, triplify


@pytest.fixture(scope="module")
def graph(spark):
    customers, products, orders = generate_entities(spark, 60, 400, 900)
    hot = orders.withColumn("customer", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("customer")))
    items = spark.range(400).select(F.lit(9).alias("order"), F.col("id").alias("product"))
    more = triplify(items, Template(":ORD", "order", 7), None, {":contains": Template(":P", "product", 6)}, "branches")
    rows = entity_graph(customers.withColumn("country", F.lit("Norway")), products, hot, "branches").unionByName(more)
    return rows.distinct()


@pytest.mark.parametrize(
    "query",
    [
        ec.q2_customer_orders,
        lambda g: ec.q3_join_3_entities(g, limit=100_000),
        lambda g: ec.q4_optional_aggregation(g, single_valued=()),
        lambda g: ec.pg_q3_join_3_entities(g, limit=100_000),
    ],
)
def test_results_do_not_depend_on_where_keys_are_split(graph, monkeypatch, query):
    plain = query(graph).collect()
    monkeypatch.setattr(joins, "HOT_ROWS", 40)
    assert plain and query(graph).collect() == plain


def test_q4_both_ways_agree_under_skew(graph):
    assert as_set(ec.q4_optional_aggregation(graph)) == as_set(ec.q4_optional_aggregation(graph, single_valued=ec.ORDER_FACTS))
