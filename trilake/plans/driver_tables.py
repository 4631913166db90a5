"""The TPC-H-like tables as a graph and as a measurement log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.functions.values import email_address
from trilake.sources.tables import Literal, Name, Template, date, double, integer, triplify
from trilake.vocab import OPERATIONS, SCALES

CUSTOMERS_GRAPH = "http://benchmark.example/g/customers"
PARTS_GRAPH = "http://benchmark.example/g/parts"
#: Order lines that a task gets, about, where a graph is built to be written or gathered.
CELL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with the name of its nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer")
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
    return named.select(
        "c_custkey", "c_name", email_address(F.col("c_name"), "#").alias("email"), "n_name", "c_mktsegment", "c_acctbal"
    )


def customer_triples(spark: SparkSession, sf_dir: str, layout: str = "branches") -> DataFrame:
    return triplify(
        customer_rows(spark, sf_dir),
        Template(":C", "c_custkey", 6),
        ":Customer",
        {
            "rdfs:label": Literal("c_name"),
            ":email": Literal("email"),
            ":country": Name(":", "n_name"),
            ":segment": Name(":", "c_mktsegment"),
            ":acctBal": double("c_acctbal"),
        },
        layout,
    )


def product_triples(spark: SparkSession, sf_dir: str, layout: str = "branches") -> DataFrame:
    return triplify(
        table(spark, sf_dir, "part"),
        Template(":P", "p_partkey", 6),
        ":Product",
        {
            "rdfs:label": Literal("p_name"),
            ":unitPrice": double("p_retailprice"),
            ":category": Literal("p_type"),
            ":stockLevel": integer("p_size"),
        },
        layout,
    )


def order_triples(spark: SparkSession, sf_dir: str, layout: str = "branches") -> DataFrame:
    """Orders, their quantity (summed over lines) and the products they contain (a set)."""
    subject = Template(":ORD", "o_orderkey", 7)
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    facts = triplify(
        orders,
        subject,
        ":Order",
        {
            ":placedBy": Template(":C", "o_custkey", 6),
            ":totalAmount": double("o_totalprice"),
            ":orderDate": date("o_orderdate"),
            ":orderStatus": Literal("o_orderstatus"),
        },
        layout,
    )
    lines = table(spark, sf_dir, "lineitem")
    quantity = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
    quantities = triplify(quantity, Template(":ORD", "l_orderkey", 7), None, {":quantity": integer("quantity")}, layout)
    pairs = lines.select("l_orderkey", "l_partkey")
    if layout == "rows":
        # Lines of an order meet before anything is gathered, in cells of a bounded number of rows.
        cells = max(spark.sparkContext.defaultParallelism, -(-lines.count() // CELL_ROWS))
        pairs = pairs.repartition(cells, "l_orderkey")
    pairs = pairs.distinct()
    contents = triplify(
        pairs, Template(":ORD", "l_orderkey", 7), None, {":contains": Template(":P", "l_partkey", 6)}, layout
    )
    return facts.unionByName(quantities).unionByName(contents)


def graph(spark: SparkSession, sf_dir: str, layout: str = "branches") -> DataFrame:
    """The whole graph. ``branches`` is the virtual graph to query, ``rows`` the one to write out."""
    return (
        customer_triples(spark, sf_dir, layout)
        .unionByName(product_triples(spark, sf_dir, layout))
        .unionByName(order_triples(spark, sf_dir, layout))
    )


def named_graphs(spark: SparkSession, sf_dir: str, layout: str = "branches") -> DataFrame:
    """Customers and parts in named graphs, orders in the default graph."""
    customers = customer_triples(spark, sf_dir, layout).withColumn("g", F.lit(CUSTOMERS_GRAPH))
    parts = product_triples(spark, sf_dir, layout).withColumn("g", F.lit(PARTS_GRAPH))
    return customers.unionByName(parts).unionByName(order_triples(spark, sf_dir, layout))


def measurement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: framework, scale, operation, seconds, and ``ts, event_id`` as order."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    raw = list(OPERATIONS)
    two_digits = F.col("value").cast("decimal(18,2)").cast("string")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
        .select(
            F.col("event_type").alias("framework"),
            F.element_at(F.array(*[F.lit(s) for s in SCALES]), (F.col("user_id") % 3 + 1).cast("int")).alias("scale"),
            F.element_at(F.array(*[F.lit(o) for o in raw]), F.col("k") % 8 + 1).alias("operation"),
            F.when(F.col("k") % 10 == 0, "TIMEOUT")
            .when(F.col("k") % 10 == 1, "N/A")
            .when(F.col("k") % 10 == 2, "FAILED")
            .otherwise(two_digits)
            .alias("seconds"),
            "ts",
            "event_id",
        )
    )
