import random

from pyspark.sql import functions as F

from trilake.operators import isomorphism
from trilake.operators.isomorphism import bnode_colours, canonical_graph, graph_differences
from trilake.session import kept

P = [":p", ":q"]


def renamed(rows, seed):
    labels = sorted({t for s, _, o in rows for t in (s, o) if t.startswith("_:")})
    order = list(range(len(labels)))
    random.Random(seed).shuffle(order)
    new = {a: f"_:other{i}" for a, i in zip(labels, order)}
    return [(new.get(s, s), p, new.get(o, o)) for s, p, o in rows]


def test_names_do_not_matter_and_triples_do(spark, graph_of):
    rng = random.Random(5)
    node = lambda: rng.choice([f"_:b{rng.randint(0, 9)}", f"<http://a/{rng.randint(0, 5)}>"])
    rows = sorted({(node(), rng.choice(P), node() if rng.random() < 0.7 else f'"{rng.randint(0, 3)}"') for _ in range(60)})
    rows += [("_:b1", ":self", "_:b1"), ("_:b2", ":p", '"_:b1"')]
    graph, other = graph_of(rows), renamed(rows, 1)
    assert graph_differences(graph, graph_of(other + other[:5]).repartition(3)).count() == 0
    at = next(i for i, (s, p, o) in enumerate(other) if s.startswith("_:") and o.startswith("_:") and s != o)
    s, p, o = other[at]
    for changed in ([*other[:at], *other[at + 1 :]], [*other[:at], (o, p, s), *other[at + 1 :]], [*other, ("_:new", ":p", "_:new")]):
        if set(changed) != set(other):
            assert graph_differences(graph, graph_of(changed)).count() > 0


def test_a_chain_and_a_hub(spark, graph_of):
    chain = [(f"_:c{i}", ":next", f"_:c{i + 1}") for i in range(7)]
    hub = [("_:hub", ":has", f"_:h{i}") for i in range(50)] + [(f"_:h{i}", ":n", f'"{i // 2}"') for i in range(50)]
    colours = {r.node: r.colour for r in bnode_colours(graph_of(chain + hub)).collect()}
    assert len({colours[f"_:c{i}"] for i in range(8)}) == 8
    assert all((colours[f"_:h{i}"] == colours[f"_:h{j}"]) == (i // 2 == j // 2) for i in range(50) for j in range(50))
    alike = canonical_graph(graph_of(chain + hub)).collect()
    assert sorted(r.n for r in alike) == [1] * 7 + [2] * 50
    assert graph_differences(graph_of(chain + hub), graph_of(renamed(chain + hub, 3))).count() == 0
    assert graph_differences(graph_of(chain + hub), graph_of(chain + hub[:-1] + [("_:h49", ":n", '"0"')])).count() > 0


def test_graphs_without_blank_nodes(spark, graph_of):
    plain = [("<http://a/1>", ":p", "<http://a/2>"), ("<http://a/1>", ":p", '"_:x"')]
    assert bnode_colours(graph_of(plain)).count() == 0
    assert canonical_graph(graph_of(plain)).count() == 2
    assert graph_differences(graph_of(plain), graph_of(plain[:1])).count() == 1
    assert graph_differences(graph_of([]), graph_of([])).count() == 0


def test_rounds_end_when_all_nodes_are_told_apart(graph_of, monkeypatch):
    written = []
    monkeypatch.setattr(isomorphism, "kept", lambda df, label: written.append(label) or kept(df, label))
    rows = [(f"_:a{i}", ":n", f'"{i}"') for i in range(9)]
    assert bnode_colours(graph_of(rows)).select("colour").distinct().count() == 9
    assert written.count("bnode-colours") == 2  # the first colours and one round


def test_a_canonical_graph_is_found_once(graph_of):
    rows = [(":c", ":address", "_:a"), ("_:a", ":n", '"1"'), ("_:a", ":in", "_:b")]
    found = canonical_graph(graph_of(renamed(rows, 2)))
    assert graph_differences(graph_of(rows), None, found).count() == 0
    assert graph_differences(graph_of(rows[:2]), None, found).count() > 0


def test_sums_of_hashes_at_a_large_hub(spark, graph_of):
    hub = spark.range(3000).selectExpr("'_:h' AS s", "':p' AS p", "CAST(id AS STRING) AS o", "'literal' AS o_kind")
    blank = {c: F.lit(None).cast("string") for c in ("o_dtype", "o_lang", "g")}
    rows = hub.withColumns(blank)
    moved = rows.withColumn("s", F.lit("_:x")).repartition(5)
    assert graph_differences(rows, moved).count() == 0
    assert graph_differences(rows, moved.where("o <> '7'")).count() > 0
