"""A seeded synthetic e-commerce graph: customers, products, orders.

Every column is a hash of the row number, so rows are independent of each other: any
number of tasks produces the same tables, and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.functions import values
from trilake.functions.values import pick, seeded_hash, uniform_cents, uniform_int
from trilake.sources.tables import Literal, Name, Template, date, double, integer, triplify
from trilake.vocab import CATEGORIES, COUNTRIES, FIRST_NAMES, LAST_NAMES, PRODUCT_NAMES, SEGMENTS, STATUSES


def customers_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A customer for each row of `ids` (a column ``id``); what else it holds stays out."""

    def h(salt: int):
        return seeded_hash(F.col("id"), salt, seed)

    named = ids.withColumn("name", F.concat_ws(" ", pick(FIRST_NAMES, h(1)), pick(LAST_NAMES, h(2))))
    return named.select(
        "id",
        "name",
        values.email_address(F.col("name")).alias("email"),
        pick(COUNTRIES, h(3)).alias("country"),
        pick(SEGMENTS, h(4)).alias("segment"),
        values.date_from_parts(
            uniform_int(h(5), 2020, 2025), uniform_int(h(6), 1, 12), uniform_int(h(7), 1, 28)
        ).alias("signup_date"),
    )


def products_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A product for each row of `ids`."""

    def h(salt: int):
        return seeded_hash(F.col("id"), salt, seed)

    return ids.select(
        "id",
        F.when(F.col("id") < len(PRODUCT_NAMES), pick(PRODUCT_NAMES, h(11)))
        .otherwise(F.concat(F.lit("Product-"), F.col("id").cast("string")))
        .alias("name"),
        uniform_cents(h(12), 29.99, 2999.99).alias("unit_price"),
        pick(CATEGORIES, h(13)).alias("category"),
        uniform_int(h(14), 0, 500).alias("stock_level"),
    )


def orders_of(ids: DataFrame, n_products: int, n_customers: int | None = None, seed: int = 42) -> DataFrame:
    """An order for each row of `ids`, for one of the products 0 to ``n_products - 1``.

    Customers are drawn from 0 to ``n_customers - 1``; without that number `ids` has a
    column ``customer``, so that orders pile up as they do in a table at hand.
    """

    def h(salt: int):
        return seeded_hash(F.col("id"), salt, seed)

    customer = F.col("customer") if n_customers is None else (h(21) % n_customers).alias("customer")
    return ids.select(
        "id",
        customer,
        (h(22) % n_products).alias("product"),
        uniform_int(h(23), 1, 20).alias("quantity"),
        uniform_cents(h(24), 50, 5000).alias("amount"),
        values.date_from_parts(
            uniform_int(h(25), 2021, 2025), uniform_int(h(26), 1, 12), uniform_int(h(27), 1, 28)
        ).alias("order_date"),
        pick(STATUSES, h(28)).alias("status"),
    )


def generate_entities(
    spark: SparkSession, n_customers: int, n_products: int, n_orders: int, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables ``(customers, products, orders)`` of the given sizes."""
    return (
        customers_of(spark.range(n_customers), seed),
        products_of(spark.range(n_products), seed),
        orders_of(spark.range(n_orders), n_products, n_customers, seed),
    )


def entity_graph(customers: DataFrame, products: DataFrame, orders: DataFrame, layout: str = "rows") -> DataFrame:
    """The generated tables as triples: 6 a customer, 5 a product, 7 an order."""
    customer_triples = triplify(
        customers,
        Template(":C", "id", 6),
        ":Customer",
        {
            "rdfs:label": Literal("name"),
            ":email": Literal("email"),
            ":country": Name(":", "country"),
            ":segment": Name(":", "segment"),
            ":signupDate": date("signup_date"),
        },
        layout,
    )
    product_triples = triplify(
        products,
        Template(":P", "id", 6),
        ":Product",
        {
            "rdfs:label": Literal("name"),
            ":unitPrice": double("unit_price"),
            ":category": Literal("category"),
            ":stockLevel": integer("stock_level"),
        },
        layout,
    )
    order_triples = triplify(
        orders,
        Template(":ORD", "id", 7),
        ":Order",
        {
            ":placedBy": Template(":C", "customer", 6),
            ":contains": Template(":P", "product", 6),
            ":quantity": integer("quantity"),
            ":totalAmount": double("amount"),
            ":orderDate": date("order_date"),
            ":orderStatus": Literal("status"),
        },
        layout,
    )
    return customer_triples.unionByName(product_triples).unionByName(order_triples)
