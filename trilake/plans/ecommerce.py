"""The four benchmark queries over a graph, and their twins over its property graph.

Each function takes any triples DataFrame (virtual, in memory, or a store) and returns
the result table. Sums run over decimals of twelve digits after the point, so they do not
depend on the order of rows; amounts too large for those are added as doubles.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions.terms import local_name
from trilake.operators import propgraph as pg
from trilake.operators.graphs import count_triples
from trilake.operators.joins import hot_join, hot_values
from trilake.operators.patterns import Pattern, V, bgp, optional, pattern, semi_join

MONEY = "double"
EXACT = "decimal(38,12)"
COUNTRY = ":Norway"

# What holds for every subject of the benchmark graph: one value per predicate.
ORDER_FACTS = (":placedBy", ":totalAmount", ":orderStatus")
# Where triples can pile up: on one customer, on one order.
SKEWED = (":placedBy", ":contains")


def exact_sum(amount: Column, exact: str = EXACT) -> Column:
    """The sum of doubles as a struct of an exact part and of what does not fit in it."""
    fits = amount.try_cast(exact)
    return F.struct(F.sum(fits).alias("fits"), F.sum(F.when(fits.isNull(), amount)).alias("large"))


def sum_of_sums(parts: Column) -> Column:
    """The total of structs made by `exact_sum`; null if none has a value."""
    fits, large = F.sum(parts["fits"]).cast("double"), F.sum(parts["large"])
    return F.coalesce(fits + large, fits, large)


def _total(total: Column, empty_sum: str) -> Column:
    return F.coalesce(total, F.lit(0.0)) if empty_sum == "zero" else total


def _order_totals(orders: DataFrame) -> DataFrame:
    """Orders and spend per customer.

    Taken before the join with what is known about the customer: one row per customer
    is joined in place of one per order, and a customer with very many orders is one
    row like any other. Sums and counts of the parts add up to those of the whole.
    """
    return orders.groupBy("customer").agg(F.count("order").alias("n"), exact_sum(F.col("amount")).alias("spend"))


def q1_count(graph: DataFrame) -> DataFrame:
    """The number of all triples."""
    return count_triples(graph)


def q2_customer_orders(graph: DataFrame, limit: int = 20, strategy: str = "join") -> DataFrame:
    """Orders and spend per customer name (equal names are one group), top spenders."""
    orders = bgp(
        graph,
        [
            (V("order"), ":placedBy", V("customer")),
            (V("order"), ":totalAmount", V("amount", MONEY)),
        ],
        strategy=strategy,
        single_valued=ORDER_FACTS,
    )
    names = pattern(graph, V("customer"), "rdfs:label", V("customer_name"))
    grouped = (
        _order_totals(orders)
        .join(names, "customer")
        .groupBy("customer_name")
        .agg(F.sum("n").alias("order_count"), sum_of_sums(F.col("spend")).alias("total_spend"))
    )
    return grouped.orderBy(F.desc_nulls_last("total_spend"), "customer_name", "order_count").limit(limit)


def q3_join_3_entities(
    graph: DataFrame, country: str = COUNTRY, limit: int = 50, strategy: str = "join"
) -> DataFrame:
    """The largest orders of one country's customers, with the products in them.

    The country comes first, as it keeps few customers: all later joins are as small as
    it makes them.
    """
    rows = bgp(
        graph,
        [
            (V("customer"), ":country", country),
            (V("customer"), "rdfs:label", V("customer_name")),
            (V("order"), ":placedBy", V("customer")),
            (V("order"), ":totalAmount", V("amount", "double")),
            (V("order"), ":orderStatus", V("status")),
            (V("order"), ":contains", V("product")),
            (V("product"), "rdfs:label", V("product_name")),
        ],
        strategy=strategy,
        single_valued=ORDER_FACTS,
        skewed=SKEWED,
    )
    shown = rows.select("customer_name", "product_name", "amount", "status")
    return shown.orderBy(F.desc_nulls_last("amount"), "customer_name", "product_name", "status").limit(limit)


def q4_optional_aggregation(
    graph: DataFrame, empty_sum: str = "null", single_valued: Collection[str] = (), strategy: str = "join"
) -> DataFrame:
    """Customers, orders and revenue per country and segment; customers without orders count.

    Where the graph is known to hold one value per order and predicate, name those in
    `single_valued` (``ORDER_FACTS``): orders are then totalled before the join.
    """
    members = bgp(
        graph,
        [
            (V("customer"), "rdf:type", ":Customer"),
            (V("customer"), ":country", V("country")),
            (V("customer"), ":segment", V("segment")),
        ],
    )
    order_group = [
        (V("order"), ":placedBy", V("customer")),
        (V("order"), ":totalAmount", V("amount", MONEY)),
    ]
    return revenue_by_group(members, graph, order_group, empty_sum, single_valued, strategy)


def revenue_by_group(
    members: DataFrame,
    graph: DataFrame,
    order_group: Sequence[Pattern],
    empty_sum: str = "null",
    single_valued: Collection[str] = (),
    strategy: str = "join",
    where: Column | None = None,
) -> DataFrame:
    """The aggregation of q4 over members and an OPTIONAL group of orders.

    If every predicate of the group is single-valued, an order has one row and one
    customer: orders are then totalled per customer before the join. Otherwise an order
    can have several rows in a group of customers but counts once there, so customers
    and orders are counted as distinct values after the join.
    """
    if {p for _, p, _ in order_group} <= set(single_valued):
        orders = bgp(graph, order_group, strategy=strategy, single_valued=single_valued)
        kept = orders.where(where) if where is not None else orders
        rows = members.join(_order_totals(kept), "customer", "left")
        customers, n_orders, revenue = F.count("customer"), F.coalesce(F.sum("n"), F.lit(0)), sum_of_sums(F.col("spend"))
    else:
        rows = optional(members, graph, order_group, where=where, skewed=SKEWED)
        customers, n_orders = F.count_distinct("customer"), F.count_distinct("order")
        fits = F.col("amount").try_cast(EXACT)
        revenue = sum_of_sums(F.struct(fits.alias("fits"), F.when(fits.isNull(), F.col("amount")).alias("large")))
    grouped = rows.groupBy("country", "segment").agg(
        customers.alias("customers"),
        n_orders.cast("bigint").alias("orders"),
        _total(revenue, empty_sum).alias("revenue"),
    )
    shown = [local_name(F.col("country")).alias("country"), local_name(F.col("segment")).alias("segment")]
    return grouped.select(*shown, "customers", "orders", "revenue").orderBy(
        F.desc_nulls_last("revenue"), "country", "segment"
    )


def orders_of_country(graph: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Orders whose customer lives in one country: a pattern used as a semi-join."""
    orders = pattern(graph, V("order"), ":placedBy", V("customer"))
    return semi_join(orders, graph, (V("customer"), ":country", country))


# ---------------------------------------------------------------- property graph


# Country and segment are IRIs in the graph; the queries read them as properties too.
AS_PROPS = ("country", "segment")


def pg_q1_count(graph: DataFrame) -> DataFrame:
    """The number of all nodes, not triples."""
    return pg.count_nodes(graph)


def _prop(graph: DataFrame, key: str, uri: str, value: str, as_type: str | None = None) -> DataFrame:
    """Nodes with property `key`, under the names `uri` and `value`."""
    found = pg.property_values(graph, key, AS_PROPS)
    shown = F.col("value").try_cast(as_type) if as_type else F.col("value")
    return found.select(F.col("uri").alias(uri), shown.alias(value))


def _placed(graph: DataFrame) -> DataFrame:
    return pg.to_edges(graph, ["placedBy"]).select(F.col("src").alias("order"), F.col("dst").alias("customer"))


def pg_q2_customer_orders(graph: DataFrame, limit: int = 20) -> DataFrame:
    orders = _placed(graph).join(_prop(graph, "totalAmount", "order", "amount", MONEY), "order")
    grouped = (
        _order_totals(orders)
        .join(_prop(graph, "label", "customer", "customer_name"), "customer")
        .groupBy("customer_name")
        .agg(F.sum("n").alias("order_count"), sum_of_sums(F.col("spend")).alias("total_spend"))
    )
    return grouped.orderBy(F.desc_nulls_last("total_spend"), "customer_name", "order_count").limit(limit)


def pg_q3_join_3_entities(graph: DataFrame, country: str = "Norway", limit: int = 50) -> DataFrame:
    """Two edge patterns that share the order node; the country comes first."""
    of_country = _prop(graph, "country", "customer", "country").where(F.col("country") == country).select("customer")
    customers = of_country.join(_prop(graph, "label", "customer", "customer_name"), "customer")
    amounts = _prop(graph, "totalAmount", "order", "amount", "double")
    states = _prop(graph, "orderStatus", "order", "status")
    products = _prop(graph, "label", "product", "product_name")
    placed = _placed(graph)
    contains = pg.to_edges(graph, ["contains"]).select(F.col("src").alias("order"), F.col("dst").alias("product"))
    hot = hot_values([(placed, "customer"), (contains, "order"), (contains, "product")])
    orders = hot_join(placed, customers, ["customer"], hot[0]).join(amounts, "order").join(states, "order")
    named = hot_join(hot_join(contains, orders, ["order"], hot[1]), products, ["product"], hot[2])
    rows = named.select("customer_name", "product_name", "amount", "status")
    return rows.orderBy(F.desc_nulls_last("amount"), "customer_name", "product_name", "status").limit(limit)


def pg_q4_optional_aggregation(graph: DataFrame, empty_sum: str = "zero") -> DataFrame:
    """Here, unlike in q4, a group without orders has revenue 0, unless told otherwise."""
    members = (
        pg.labelled(graph, "Customer")
        .withColumnRenamed("uri", "customer")
        .join(_prop(graph, "country", "customer", "country"), "customer")
        .join(_prop(graph, "segment", "customer", "segment"), "customer")
    )
    # An edge set: a customer and an order meet once, and an order has one customer.
    orders = _placed(graph).join(_prop(graph, "totalAmount", "order", "amount", MONEY), "order")
    grouped = (
        members.join(_order_totals(orders), "customer", "left")
        .groupBy("country", "segment")
        .agg(
            F.count("customer").alias("customers"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orders"),
            _total(sum_of_sums(F.col("spend")), empty_sum).alias("revenue"),
        )
    )
    return grouped.orderBy(F.desc_nulls_last("revenue"), "country", "segment")


def pg_view(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the benchmark graph with what its queries look at."""
    keys = ["label", "totalAmount", "orderStatus", *AS_PROPS]
    return pg.to_nodes(graph, AS_PROPS, keys), pg.to_edges(graph, ["placedBy", "contains"])
