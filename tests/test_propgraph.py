from conftest import as_set
from pyspark.sql import functions as F

from test_patterns import ORDERS
from trilake.operators import propgraph as pg
from trilake.plans import driver_tables as dt
from trilake.plans import ecommerce as ec
from trilake.vocab import NS


def flat(nodes):
    return {r.uri.replace(NS, ""): (r.labels, r.props) for r in nodes.collect()}


def test_nodes_and_edges(graph_of):
    g = graph_of(ORDERS + [(":c1", "rdfs:label", '"Zed"'), ("_:b", ":knows", ":c1")])
    nodes = flat(pg.to_nodes(g))
    assert nodes["c1"] == (["Customer"], {"label": "Zed"})  # the greatest of two labels
    assert nodes["Norway"] == ([], {}) and "Customer" not in nodes
    assert nodes["c4"] == (["Customer"], {"label": "Cy", "country": "Norway"})
    assert nodes["_:b"] == ([], {})
    edges = pg.to_edges(g)
    assert (NS + "o1", "placedBy", NS + "c1") in as_set(edges) and edges.where("type = 'type'").count() == 0
    as_props = flat(pg.to_nodes(g, ["country"]))
    assert as_props["c1"][1] == {"label": "Zed", "country": "Norway"}
    assert set(as_props) == set(nodes)


def test_keys_narrow_the_nodes(graph_of):
    nodes = flat(pg.to_nodes(graph_of(ORDERS), keys=["totalAmount"]))
    assert set(nodes) == {"c1", "c2", "c3", "c4", "o1", "o2", "o4"}
    assert nodes["o1"] == ([], {"totalAmount": "10.5"}) and nodes["c1"] == (["Customer"], {})


def test_schema_and_samples(graph_of):
    nodes, edges = pg.to_nodes(graph_of(ORDERS)), pg.to_edges(graph_of(ORDERS))
    assert {r.kind: r.names for r in pg.schema_lists(nodes, edges).collect()} == {
        "label": ["Customer"],
        "property": ["country", "label", "orderStatus", "totalAmount"],
        "relationship": ["contains", "country", "placedBy", "segment"],
    }
    assert pg.sample_nodes(nodes, 2).count() == 2


def test_expand_with_hot_nodes(graph_of, monkeypatch):
    g = graph_of(ORDERS)
    nodes, edges = ec.pg_view(g)
    ends = [nodes.select(F.col("uri").alias(c)) for c in ("src", "dst")]
    plain = as_set(pg.expand(edges, "placedBy", *ends).select("src", "dst"))
    monkeypatch.setattr("trilake.operators.joins.HOT_ROWS", 1)
    assert as_set(pg.expand(edges, "placedBy", *ends).select("src", "dst")) == plain
    assert (NS + "o1", NS + "c1") in plain


def test_twins_agree_with_the_graph_queries(graph_of):
    g = graph_of([t for t in ORDERS if t[0] != ":c4"])
    assert as_set(ec.pg_q2_customer_orders(g)) == as_set(ec.q2_customer_orders(g))
    assert as_set(ec.pg_q3_join_3_entities(g)) == as_set(ec.q3_join_3_entities(g))
    assert as_set(ec.pg_q4_optional_aggregation(g)) == as_set(ec.q4_optional_aggregation(g, empty_sum="zero"))
    assert ec.pg_q1_count(g).first()[0] == 11  # customers, orders, product, 2 countries, segment


def test_pushed_down_operators_agree_with_nodes(graph_of):
    g = graph_of(ORDERS + [(":c1", "rdfs:label", '"Zed"'), ("_:b", ":knows", ":c1")])
    nodes, edges = pg.to_nodes(g, ["country"]), pg.to_edges(g)
    assert as_set(pg.labelled(g, "Customer")) == as_set(pg.label_scan(nodes, "Customer").select("uri"))
    for key in ("label", "country", "totalAmount"):
        assert as_set(pg.property_values(g, key, ["country"])) == as_set(pg.has_props(nodes, key).select("uri", pg.prop(key)))
    assert as_set(pg.count_nodes(g)) == as_set(pg.node_count(nodes))
    lists = lambda df: {(r.kind, *r.names) for r in df.collect()}
    assert lists(pg.schema_of(g)) == lists(pg.schema_lists(pg.to_nodes(g), edges))


def test_sums_lose_no_amount(graph_of):
    amounts = ['"12"^^xsd:double', '"1.004"^^xsd:double', '"1e17"^^xsd:double', '"1e30"^^xsd:double']
    rows = [(":c", "rdfs:label", '"C"')]
    for i, amount in enumerate(amounts):
        rows += [(f":o{i}", ":placedBy", ":c"), (f":o{i}", ":totalAmount", amount)]
    g = graph_of(rows)
    assert as_set(ec.q2_customer_orders(g)) == as_set(ec.pg_q2_customer_orders(g)) == {("C", 4, 1e30 + 1e17 + 13.004)}
    assert ec.q2_customer_orders(graph_of(rows[:5])).first().total_spend == 13.004


def test_nodes_meet_once(graph_of):
    """Rows are shuffled by their node only, and ends of edges are combined before that."""
    g = graph_of(ORDERS)
    plan = pg.to_nodes(g)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert shuffles and not any("label" in line for line in shuffles)
    many = graph_of([(f":o{i}", ":placedBy", ":hub") for i in range(50)] + [(":hub", "rdfs:label", f'"{i:02}"') for i in range(20)])
    assert flat(pg.to_nodes(many))["hub"] == ([], {"label": "19"}) and pg.to_nodes(many).count() == 51


def test_lines_of_an_order_share_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dt, "CELL_ROWS", 10, raising=False)
    spark.range(300).selectExpr("id % 60 AS l_orderkey", "id % 7 AS l_partkey", "1 AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(60).selectExpr("id AS o_orderkey", "id AS o_custkey", "1.5D AS o_totalprice", "DATE'2020-01-01' AS o_orderdate", "'F' AS o_orderstatus")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    contents = dt.order_triples(spark, str(tmp_path), "rows").where(F.col("p") == NS + "contains")
    placed = {(r.s, r.task) for r in contents.select("s", F.spark_partition_id().alias("task")).distinct().collect()}
    assert len(placed) == 60 and len({task for _, task in placed}) > 8
    branches = dt.order_triples(spark, str(tmp_path)).where(F.col("p") == NS + "contains")
    assert sorted(map(tuple, contents.collect())) == sorted(map(tuple, branches.collect()))
