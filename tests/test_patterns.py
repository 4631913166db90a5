import pytest
from conftest import as_set
from pyspark.sql import functions as F

from trilake.operators import joins
from trilake.operators.patterns import Lit, V, bgp, optional, pattern, semi_join
from trilake.plans import ecommerce as ec
from trilake.vocab import NS

ORDERS = [
    (":c1", "rdf:type", ":Customer"), (":c1", ":country", ":Norway"), (":c1", ":segment", ":SMB"), (":c1", "rdfs:label", '"Ann"'),
    (":c2", "rdf:type", ":Customer"), (":c2", ":country", ":Norway"), (":c2", ":segment", ":SMB"), (":c2", "rdfs:label", '"Ann"'),
    (":c3", "rdf:type", ":Customer"), (":c3", ":country", ":Sweden"), (":c3", ":segment", ":SMB"), (":c3", "rdfs:label", '"Bo"'),
    (":c4", "rdf:type", ":Customer"), (":c4", ":country", '"Norway"'), (":c4", ":segment", ":SMB"), (":c4", "rdfs:label", '"Cy"'),
    (":p1", "rdfs:label", '"Pen"'),
    (":o1", ":placedBy", ":c1"), (":o1", ":totalAmount", '"10.5"^^xsd:double'), (":o1", ":orderStatus", '"open"'), (":o1", ":contains", ":p1"),
    (":o2", ":placedBy", ":c2"), (":o2", ":totalAmount", '"4.5"^^xsd:double'), (":o2", ":orderStatus", '"open"'), (":o2", ":contains", ":p1"),
    (":o3", ":placedBy", ":c3"),  # half an order: no amount
    (":o4", ":placedBy", ":c1"), (":o4", ":totalAmount", '"bad"^^xsd:double'), (":o4", ":orderStatus", '"open"'),
]


def names(df):
    return {tuple(x.replace(NS, "") if isinstance(x, str) else x for x in r) for r in df.collect()}


def test_constants_in_every_place(graph_of):
    g = graph_of(ORDERS)
    assert names(pattern(g, V("c"), ":country", ":Norway")) == {("c1",), ("c2",)}
    assert names(pattern(g, V("c"), ":country", Lit("Norway"))) == {("c4",)}
    assert names(pattern(g, ":o1", V("p"), ":c1")) == {("placedBy",)}
    assert pattern(g, V("s"), V("p"), V("o")).count() == len(ORDERS)
    assert pattern(g, V("x"), ":placedBy", V("x")).count() == 0


def test_literal_constants_compare_datatype_and_language(graph_of):
    g = graph_of([(":a", ":p", '"1"'), (":b", ":p", '"1"^^xsd:integer'), (":c", ":p", '"1"@en')])
    assert names(pattern(g, V("s"), ":p", Lit("1"))) == {("a",)}
    assert names(pattern(g, V("s"), ":p", Lit("1", "xsd:integer"))) == {("b",)}
    assert names(pattern(g, V("s"), ":p", Lit("1", lang="en"))) == {("c",)}


def test_star_and_join_agree(graph_of):
    g = graph_of(ORDERS)
    star = [(V("o"), ":placedBy", V("c")), (V("o"), ":totalAmount", V("a", "double")), (V("o"), ":orderStatus", V("s"))]
    joined = names(bgp(g, star))
    assert joined == names(bgp(g, star, strategy="star", single_valued=ec.ORDER_FACTS))
    assert joined == {("o1", "c1", 10.5, "open"), ("o2", "c2", 4.5, "open"), ("o4", "c1", None, "open")}
    with_constant = [*star, (V("o"), ":orderStatus", Lit("open"))]
    assert names(bgp(g, with_constant, strategy="star", single_valued=ec.ORDER_FACTS)) == joined


def test_a_literal_never_joins_an_iri(graph_of):
    g = graph_of([(":a", ":p", f'"{NS}x"'), (":b", ":p", ":x"), (":x", ":q", ":y"), (":z", ":r", f'"{NS}x"')])
    assert names(bgp(g, [(V("s"), ":p", V("m")), (V("m"), ":q", V("e"))])) == {("b", "x", "y")}
    assert names(bgp(g, [(V("s"), ":p", V("m")), (V("t"), ":r", V("m"))])) == {("a", "x", "z")}
    rows = bgp(g, [(V("s"), ":p", V("m"))], optionals=[[(V("m"), ":q", V("e"))]])
    assert {(r.s.replace(NS, ""), r.e is not None) for r in rows.collect()} == {("a", False), ("b", True)}


def test_half_matched_optional_is_unbound(graph_of):
    g = graph_of(ORDERS)
    group = [(V("o"), ":placedBy", V("c")), (V("o"), ":totalAmount", V("a", "double"))]
    rows = bgp(g, [(V("c"), "rdf:type", ":Customer")], optionals=[group])
    assert names(rows) == {("c1", "o1", 10.5), ("c1", "o4", None), ("c2", "o2", 4.5), ("c3", None, None), ("c4", None, None)}
    filtered = optional(pattern(g, V("c"), "rdf:type", ":Customer"), g, group, where=F.col("a") > 5)
    assert names(filtered) == {("c1", "o1", 10.5), ("c2", None, None), ("c3", None, None), ("c4", None, None)}


def test_skewed_patterns_give_the_same_bindings(graph_of, monkeypatch):
    rows = ORDERS + [(f":x{i}", ":placedBy", ":c1") for i in range(40)]
    g = graph_of(rows)
    required = [(V("c"), "rdf:type", ":Customer"), (V("o"), ":placedBy", V("c"))]
    group = [(V("o"), ":placedBy", V("c")), (V("o"), ":totalAmount", V("a", "double"))]
    plain = bgp(g, required), bgp(g, required[:1], optionals=[group]), optional(bgp(g, required[:1]), g, group[:1])
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    hot = (
        bgp(g, required, skewed=[":placedBy"]),
        bgp(g, required[:1], optionals=[group], skewed=[":placedBy"]),
        optional(bgp(g, required[:1]), g, group[:1], skewed=[":placedBy"]),
    )
    assert "_part" in hot[0]._jdf.queryExecution().toString()
    for a, b in zip(plain, hot):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError, match="unbound"):
        optional(hot[2], g, [(V("o"), ":totalAmount", V("a"))])


def test_no_join_on_an_unbound_variable_and_no_cross_product(graph_of):
    g = graph_of(ORDERS)
    rows = bgp(g, [(V("c"), "rdf:type", ":Customer")], optionals=[[(V("o"), ":placedBy", V("c"))]])
    with pytest.raises(ValueError, match="unbound"):
        optional(rows, g, [(V("o"), ":totalAmount", V("a"))])
    with pytest.raises(ValueError, match="cross product"):
        bgp(g, [(V("a"), ":placedBy", V("b")), (V("c"), ":country", V("d"))])
    with pytest.raises(ValueError, match="typed"):
        bgp(g, [(V("a"), ":p", V("b", "double")), (V("c"), ":q", V("b"))])


def test_semi_join(graph_of):
    g = graph_of(ORDERS)
    orders = pattern(g, V("order"), ":placedBy", V("customer"))
    plan = semi_join(orders, g, (V("customer"), ":country", ":Norway"))
    assert names(plan) == {("o1", "c1"), ("o4", "c1"), ("o2", "c2")}
    assert "LeftSemi" in plan._jdf.queryExecution().toString()


def test_q2_merges_equal_names(graph_of):
    assert as_set(ec.q2_customer_orders(graph_of(ORDERS))) == {("Ann", 3, 15.0)}


def test_q3_breaks_ties_by_the_other_columns(graph_of):
    extra = [(":o9", ":placedBy", ":c1"), (":o9", ":totalAmount", '"10.5"^^xsd:double'), (":o9", ":orderStatus", '"done"'), (":o9", ":contains", ":p1")]
    rows = ec.q3_join_3_entities(graph_of(ORDERS + extra), limit=1).collect()
    assert [tuple(r) for r in rows] == [("Ann", "Pen", 10.5, "done")]


def test_q4_both_ways_and_sums_of_nothing(graph_of):
    g = graph_of(ORDERS)
    expected = {("Norway", "SMB", 2, 3, 15.0), ("Norway", "SMB", 1, 0, None), ("Sweden", "SMB", 1, 0, None)}
    assert as_set(ec.q4_optional_aggregation(g)) == expected
    assert as_set(ec.q4_optional_aggregation(g, single_valued=ec.ORDER_FACTS)) == expected
    assert as_set(ec.q4_optional_aggregation(g, empty_sum="zero")) == {
        ("Norway", "SMB", 2, 3, 15.0), ("Norway", "SMB", 1, 0, 0.0), ("Sweden", "SMB", 1, 0, 0.0),
    }


def test_q4_counts_an_order_of_two_customers_once(graph_of):
    g = graph_of([*ORDERS, (":o1", ":placedBy", ":c2")])
    norway = [r for r in ec.q4_optional_aggregation(g, single_valued=()).collect() if r.revenue is not None]
    assert [(r.customers, r.orders, r.revenue) for r in norway] == [(2, 3, 25.5)]


def test_typed_variables_honour_the_datatype(graph_of):
    g = graph_of([(":a", ":n", '"12"'), (":a", ":n", '"7"^^xsd:integer'), (":a", ":n", '"2.5"^^xsd:double')])
    assert names(pattern(g, V("a"), ":n", V("n", "double"))) == {("a", None), ("a", 7.0), ("a", 2.5)}


def test_terms_stay_apart(graph_of):
    from trilake.sinks.results import to_sparql_json

    g = graph_of([(":a", "rdfs:label", '"x"'), (":b", "rdfs:label", '"x"@en'), (":c", "rdfs:label", ":x"), (":d", "rdfs:label", '"x"')])
    rows = pattern(g, V("s"), "rdfs:label", V("name", "term"))
    assert sorted(r["count"] for r in rows.groupBy("name").count().collect()) == [1, 1, 2]
    assert {r.value for r in to_sparql_json(rows.select("name")).collect()} == {
        '{"name":{"type":"literal","value":"x"}}',
        '{"name":{"type":"literal","value":"x","xml:lang":"en"}}',
        '{"name":{"type":"uri","value":"%sx"}}' % NS,
    }
