import pytest
from conftest import as_set

from trilake.sinks.rdf import turtle_subject_blocks, write_ntriples, write_turtle, write_turtle_grouped
from trilake.sources import turtle_lines, turtle_text
from trilake.sources.files import load_stats
from trilake.sources.ntriples import read_ntriples
from trilake.sources.turtle import read_turtle, scan_turtle
from trilake.vocab import NS, PREFIXES, RDF, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER

HEAD = "@prefix : <http://benchmark.example/> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def triples(spark, path, **kwargs):
    short = lambda x: x.replace(NS, ":")
    return {(short(r.s), short(r.p), short(r.o)) for r in read_turtle(spark, path, **kwargs).collect()}


def stats(spark, path):
    return tuple(load_stats(scan_turtle(spark, path)).first())


def test_lists(spark, tmp_path):
    path = write(tmp_path / "a.ttl", HEAD + ":C1 a :Customer ;\n  :k :x , :y ; ; .\n:C2 :k :x .\n")
    assert triples(spark, path) == {
        (":C1", RDF_TYPE, ":Customer"), (":C1", ":k", ":x"), (":C1", ":k", ":y"), (":C2", ":k", ":x"),
    }


def test_separators_inside_terms(spark, tmp_path):
    body = ':s :p "a ; b , c . # d" , <http://b/x;y,z#f> ; :q "e\\" , f"@en . # :no :no :no\n'
    path = write(tmp_path / "a.ttl", HEAD + body)
    assert {(r.o, r.o_kind, r.o_lang) for r in read_turtle(spark, path).collect()} == {
        ("a ; b , c . # d", "literal", None), ("http://b/x;y,z#f", "iri", None), ('e" , f', "literal", "en"),
    }


def test_literals_and_shorthand(spark, tmp_path):
    path = write(tmp_path / "a.ttl", HEAD + ':s :p 42 , -4.5 , 1e3 , true , "7"^^xsd:integer , "x"^^<http://b/t> .\n')
    assert {(r.o, r.o_dtype) for r in read_turtle(spark, path).collect()} == {
        ("42", XSD_INTEGER), ("-4.5", XSD_DECIMAL), ("1e3", XSD_DOUBLE), ("true", XSD_BOOLEAN),
        ("7", XSD_INTEGER), ("x", "http://b/t"),
    }


def test_no_final_newline_and_several_statements_a_record(spark, tmp_path):
    path = write(tmp_path / "a.ttl", HEAD + ":a :p :b . :c :p :d.e .\n# end .\n:f :p :g .")
    assert triples(spark, path) == {(":a", ":p", ":b"), (":c", ":p", ":d.e"), (":f", ":p", ":g")}


def test_each_file_has_its_own_prefixes(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.ttl", f"@prefix x: <http://{name}/> .\nx:s x:p x:o .\n")
    assert {r.s for r in read_turtle(spark, str(tmp_path)).collect()} == {"http://a/s", "http://b/s"}


def test_sparql_style_prefix_and_given_prefixes(spark, tmp_path):
    path = write(tmp_path / "a.ttl", "PREFIX x: <http://x/>\nx:s x:p x:o .\n")
    assert {r.s for r in read_turtle(spark, path).collect()} == {"http://x/s"}
    bare = write(tmp_path / "b.ttl", "rdfs:s :p xsd:o .\n")
    assert read_turtle(spark, bare, on_reject="count").count() == 0
    with pytest.raises(Exception, match="can't be read"):
        read_turtle(spark, bare).count()
    assert read_turtle(spark, bare, prefixes=PREFIXES).first().s == PREFIXES["rdfs"] + "s"


def test_a_prefix_bound_twice_holds_from_its_place_on(spark, tmp_path):
    path = write(tmp_path / "a.ttl", "@prefix x: <http://1/> .\nx:s x:p x:o .\nPREFIX x: <http://2/>\nx:s x:p x:o .\n")
    assert {r.s for r in read_turtle(spark, path).collect()} == {"http://1/s", "http://2/s"}
    assert stats(spark, path) == (2, 2, 0)


BAD = [
    ":s :p nope:x .", ":s :p .", ":s ; :p :o .", ":s :p , :o .", ":s :p :o , .", ":s :p :o :o2 .", ':s :p "open .', ":s :p <relative> .",
    '"s" :p :o .', ":s _:b :o .", ":s :p :o ; :q .",
]
BAD_NESTED = [":s :p [ :q :r ) .", ":s :p [ :q ] .", ":s :p ( :q , :r ) .", ":s :p ( :q .", ":s :p :o ] .", "[] ."]


@pytest.mark.parametrize("statements", [BAD, BAD_NESTED])
def test_unsupported_statements_are_counted(spark, tmp_path, statements):
    for i, statement in enumerate(statements):
        write(tmp_path / f"{i}.ttl", HEAD + ":ok :p :o .\n" + statement + "\n:ok :p :o2 .\n")
    parsed = scan_turtle(spark, str(tmp_path)).cache()
    assert tuple(load_stats(parsed).first()) == (2 * len(statements), 2, len(statements))
    assert parsed.where("not ok").count() == len(statements)


def test_a_comment_that_looks_like_a_statement_end(spark, tmp_path):
    path = write(tmp_path / "a.ttl", HEAD + ":a :p :b ; # note .\n  :q :c ; :r :d .\n:a :p :e , # note .\n  :f ; :r :d .\n# end .\n")
    assert triples(spark, path) == {(":a", ":p", ":b"), (":a", ":q", ":c"), (":a", ":r", ":d"), (":a", ":p", ":e"), (":a", ":p", ":f")}


def test_long_strings(spark, tmp_path):
    write(tmp_path / "a.ttl", HEAD + ':a :p """text "q" \\"e\\" .\n:x :y :z .\n"""@en ; :q \'\'\'no .\n\'\'\' .\n:b :p :c .\n')
    write(tmp_path / "b.ttl", HEAD + ":a :p \"it\'\'\'s\" .\n# a \"\"\" comment\n:a :p :d .\n")
    first = (":a", ":p", 'text "q" "e" .\n:x :y :z .\n')
    assert triples(spark, str(tmp_path)) == {first, (":a", ":q", "no .\n"), (":b", ":p", ":c"), (":a", ":p", "it\'\'\'s"), (":a", ":p", ":d")}
    write(tmp_path / "a.ttl", HEAD + ':a :p """text "q" \\"e\\" .\n:x :y :z .\n"""@en .\n:b :p :c .\n')
    assert {(r.o, r.o_lang) for r in read_turtle(spark, str(tmp_path)).where("o_lang is not null").collect()} == {('text "q" "e" .\n:x :y :z .\n', "en")}


def test_windows_line_ends(spark, tmp_path):
    path = write(tmp_path / "a.ttl", (HEAD + ":a :p :b .\n:c :p :d.\n:e :p :f .\n").replace("\n", "\r\n"))
    assert triples(spark, path) == {(":a", ":p", ":b"), (":c", ":p", ":d"), (":e", ":p", ":f")}


def test_blank_nodes_of_one_dataset(spark, tmp_path, graph_of):
    graph = graph_of([("_:b0", ":p", ":x"), ("_:b0", ":q", ":y"), (":s", ":r", "_:b0")]).repartition(3)
    write_turtle(graph, str(tmp_path / "ttl"))
    write_ntriples(graph, str(tmp_path / "nt"))
    for read, path in ((read_turtle, "ttl"), (read_ntriples, "nt")):
        assert as_set(read(spark, str(tmp_path / path), bnode_scope="dataset")) == as_set(graph)


AWKWARD = [
    (":s", "rdf:type", ":Thing"),
    (":s", ":p", '"semi ; comma , dot . \\" \n"'),
    (":s", ":p", '"hallo"@de'),
    (":s", ":p", '"1.5"^^xsd:double'),
    (":s", ":p", '"x"^^http://elsewhere/type'),
    (":s", "http://elsewhere/p", "http://benchmark.example/with/slash"),
    (":s", "rdfs:label", "http://benchmark.example/"),
    ("http://b/a b", ":p", "rdfs:x"),
    (":-odd", ":p", ":dot."),
]


@pytest.mark.parametrize("writer", [write_turtle, write_turtle_grouped])
def test_roundtrip(spark, tmp_path, graph_of, writer):
    graph = graph_of(AWKWARD).repartition(3)
    writer(graph, str(tmp_path / "out"))
    assert as_set(read_turtle(spark, str(tmp_path / "out"))) == as_set(graph)
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    assert files and all(f.read_text().startswith("@prefix") for f in files)


def test_both_syntaxes_give_the_same_graph(spark, tmp_path, graph_of):
    graph = graph_of(AWKWARD)
    write_turtle(graph, str(tmp_path / "ttl"))
    write_ntriples(graph, str(tmp_path / "nt"))
    assert as_set(read_turtle(spark, str(tmp_path / "ttl"))) == as_set(read_ntriples(spark, str(tmp_path / "nt")))


def test_blocks_of_a_hot_subject_are_split(spark, tmp_path, graph_of):
    graph = graph_of([(":hot", ":p", f":o{i}") for i in range(500)] + [(":cold", ":p", ":o"), (":cold", ":q", ":o")])
    blocks = turtle_subject_blocks(graph, max_block=50)
    counts = {r.subject: r["count"] for r in blocks.groupBy("subject").count().collect()}
    assert counts[":cold"] == 1 and counts[":hot"] >= 10
    assert max(r.block.count(";") for r in blocks.collect()) < 60
    write_turtle_grouped(graph, str(tmp_path / "out"))
    assert as_set(read_turtle(spark, str(tmp_path / "out"))) == as_set(graph)
    write_turtle(graph, str(tmp_path / "flat"))
    assert read_turtle(spark, str(tmp_path / "flat")).count() == 502


def test_a_subject_of_any_size_is_one_block(spark, graph_of):
    graph = graph_of([(":hot", ":p", f":o{i:04d}") for i in range(1_001)] + [(":hot", "rdf:type", ":T"), (":cold", ":p", ":o")])
    blocks = {r.subject: r.block for r in turtle_subject_blocks(graph.repartition(3)).collect()}
    assert turtle_subject_blocks(graph).count() == 2
    objects = " ;\n  ".join(f":p :o{i:04d}" for i in range(1_001))
    assert blocks == {":cold": ":cold :p :o .", ":hot": f":hot rdf:type :T ;\n  {objects} ."}


def split_small(spark):
    """Files of a few bytes are cut into many splits."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return before


LONG = HEAD + "".join(
    f':s{i} :p """one "quoted" . {i}\n:no :such :triple .\n\n# no comment\n""" , \'\'\'two """ .\n\'\'\'@en ; # note .\n  :q "a.b" , 4.5 , :x.y.\n'
    f"@prefix x: <http://{i}/> .\nx:s{i} x:p [ :q ( :a [] ( ) 'it' ) ] .\n"
    for i in range(40)
)


@pytest.mark.parametrize("lines", [3, 1 << 14])
def test_any_split_of_a_file_gives_the_same_graph(spark, tmp_path, monkeypatch, lines):
    path = write(tmp_path / "a.ttl", LONG)
    monkeypatch.setattr(turtle_lines, "CHUNK_LINES", lines)
    whole = as_set(read_turtle(spark, path))
    before = split_small(spark)
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 50
        cut = as_set(read_turtle(spark, path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert cut == whole and len(whole) == 40 * (5 + 1 + 1 + 8)
    assert {(r[2], r[5]) for r in whole if r[0] == NS + "s7" and r[1] == NS + "p"} == {
        ('one "quoted" . 7\n:no :such :triple .\n\n# no comment\n', None), ('two """ .\n', "en"),
    }


def test_nested_terms(spark, tmp_path):
    path = write(tmp_path / "a.ttl", HEAD + ":s :p [ a :T ; :q :x , [ :r 1 ] ] , ( :a ( 'b' ) [] ) ; :z () .\n[ :only :this ] .\n[] :subject :too .\n(1) :p (:l).\n")
    found = as_set(read_turtle(spark, path))
    assert stats(spark, path) == (len(found), len(found), 0)
    out = {}
    for s, p, o, *_ in found:
        out.setdefault((s, p.replace(NS, ":").replace(RDF, "rdf:")), set()).add(o)

    def items(node):
        if node == RDF + "nil":
            return []
        (first,), (rest,) = out[(node, "rdf:first")], out[(node, "rdf:rest")]
        return [first, *items(rest)]

    (none,) = out[(NS + "s", ":z")]
    assert none == RDF + "nil"
    one, two = sorted(out[(NS + "s", ":p")], key=lambda n: (n, "rdf:first") in out)
    assert out[(one, "rdf:type")] == {NS + "T"} and NS + "x" in out[(one, ":q")]
    (deep,) = out[(one, ":q")] - {NS + "x"}
    assert out[(deep, ":r")] == {"1"}
    a, inner, blank = items(two)
    assert a == NS + "a" and items(inner) == ["b"] and not any(s == blank for s, _ in out)
    assert {next(iter(o)) for (s, p), o in out.items() if p in (":only", ":subject")} == {NS + "this", NS + "too"}
    assert [items(s) + items(next(iter(o))) for (s, p), o in out.items() if p == ":p" and s != NS + "s"] == [["1", NS + "l"]]


REFERENCES = dict(
    [
        ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"),
        ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"),
        ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y"), ("urn:x", "urn:x"),
    ]
)


def test_relative_iris(spark):
    rows = spark.createDataFrame([("http://a/b/c/d;p?q", r) for r in REFERENCES], "base string, ref string")
    assert {r.ref: r.iri for r in rows.withColumn("iri", turtle_lines.resolve(rows.base, rows.ref)).collect()} == REFERENCES


def test_relative_iris_within_a_chunk():
    """Chunks resolve references themselves, as columns do."""
    assert {r: turtle_text.resolved("http://a/b/c/d;p?q", r) for r in REFERENCES} == REFERENCES
    assert [turtle_text.resolved(b, r) for b, r in (("http://a", "g"), ("urn:x:y", "z"), ("http://a/b/../c#f", "g"), ("http://a/b#f", "#h"))] == [
        "http://a/g", "urn:z", "http://a/g", "http://a/b#h",
    ]


@pytest.mark.parametrize(
    "text, ends",
    [
        (":a :p :b.:c :d . :e :f :g . :h", 2), (":a :p .5 . :b :c :d .", 2), (':a :p "x"@en.foo . :b', 1), (":a :p 'x . y' . # no .\n:b <http://a. b> .", 3),
        (':a :p """x .\n" .\n""" . :c :p """ . \n', 1), (':a :p "open .\n:b :p "x . y" .', 2), (":a :p :b\\\n# no .\n .", 1),
    ],
)
def test_statement_ends(spark, text, ends):
    """A chunk is cut where its lines would be, one by one."""
    found, left = turtle_text._cut(text + "\n", 0)
    assert len(found) == ends and ("" if not found[-1][0] else "".join(piece for piece, _ in found) + left) in ("", text + "\n")
    half = text.find("\n") + 1
    if '"""' not in text and half:  # lines that do not depend on those before them
        assert sum(len(turtle_text._cut(line + "\n", 0)[0]) for line in text.split("\n")) == ends


@pytest.mark.parametrize("lines", [4, 1 << 14])
def test_names_bound_before_their_chunk(spark, tmp_path, monkeypatch, lines):
    """Prefixes and bases from earlier chunks, some of them relative to a base from there."""
    monkeypatch.setattr(turtle_lines, "CHUNK_LINES", lines)
    text, base, own, want = "@prefix once: <http://once.example/> .\n", None, {}, set()
    for i in range(60):
        if i % 7 == 0:
            base = f"http://b.example/{i}/"
            text += f"BASE <{base}>\n"
        if i % 7 == 4:
            base = f"{base}r{i}/"
            text += f"@base <r{i}/> .\n"
        if i % 5 == 0:
            own[i % 2] = f"{base}v{i}#"
            text += f"PREFIX p{i % 2}: <v{i}#>\n"
        name = min(own, key=lambda k: (k + i) % 2)
        text += f"<s{i}> p{name}:q once:{i} ,\n 'x'^^<t>.\n"
        want |= {(f"{base}s{i}", f"{own[name]}q", f"http://once.example/{i}", None), (f"{base}s{i}", f"{own[name]}q", "x", f"{base}t")}
    path = write(tmp_path / "a.ttl", text)
    assert as_set(read_turtle(spark, path).select("s", "p", "o", "o_dtype")) == want


def test_chunks_settle_what_they_bind(spark, tmp_path):
    """A base and a prefix for each statement: only what a chunk's ends cut is left for other tables."""
    from trilake.sources.turtle import SOUND

    n = 2_000
    (tmp_path / "a.ttl").write_text("".join(f"BASE <http://b.example/{i}/>\nPREFIX : <v#> <s> :p ( <o> [ :q 'x' ] ) .\n" for i in range(n)))
    file = spark.read.text(str(tmp_path)).select("_metadata.file_path").first()[0]
    cut = turtle_lines.chunk_rows(spark, str(tmp_path), [file], [], SOUND)
    kinds = {r.kind: r["count"] for r in cut.groupBy("kind").count().collect()}
    assert kinds == {turtle_text.STATEMENT: n - 1, turtle_text.PIECE: 1, turtle_text.CHUNK: 1}
    assert cut.where("kind = 0 and opens is not null").isEmpty() and cut.where("size(found) > 2").isEmpty()
    assert read_turtle(spark, str(tmp_path)).count() == n * 6


def test_nested_query_parses_its_text_once(spark, tmp_path):
    """Eleven patterns over text with brackets read its triples from a table."""
    from trilake.plans.registry import QUERIES

    spark.createDataFrame([(i, i % 3, f"S{i % 2}") for i in range(20)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i % 20, "F") for i in range(50)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["read_turtle_nested"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "raise_error" not in plan
    want = {(f"c{i}", str(i % 3), "http://base.example/y") for i in range(20)} | {(f"o{i}", f"http://base.example/x/c{i % 20}", "F") for i in range(50)}
    assert as_set(found) == want and found.count() == 70


def test_base_holds_from_its_place_on(spark, tmp_path):
    path = write(tmp_path / "a.ttl", "@base <http://b/x/> . @prefix : <v#> .\n<s> :p <../o> .\nBASE <deep/>\n<s> :p <#f> , 'x'^^<t> .\n@prefix : <w#> .\n<s> :p :o .\n")
    assert {(r.s, r.p, r.o, r.o_dtype) for r in read_turtle(spark, path).collect()} == {
        ("http://b/x/s", "http://b/x/v#p", "http://b/o", None), ("http://b/x/deep/s", "http://b/x/v#p", "http://b/x/deep/#f", None),
        ("http://b/x/deep/s", "http://b/x/v#p", "x", "http://b/x/deep/t"), ("http://b/x/deep/s", "http://b/x/deep/w#p", "http://b/x/deep/w#o", None),
    }


def test_bindings_as_often_as_statements(spark, tmp_path):
    """A base and a prefix for each statement; some relative to the base before, some bound over chunks."""
    n = 40_000
    lines = ["@prefix once: <http://once.example/> .", "@base <http://b.example/> ."]
    for i in range(n):
        lines.append(f"@base <{'r' if i % 4 else 'http://b.example/'}{i}/> .")
        lines.append(f"@prefix p: <{'v' if i % 2 else 'http://p.example/v'}{i}#> .")
        lines.append(f"<s> p:n once:{i} .")
    (tmp_path / "many.ttl").write_text("\n".join(lines) + "\n")
    base, want = "", set()
    for i in range(n):
        base = base + f"r{i}/" if i % 4 else f"http://b.example/{i}/"
        want.add((base + "s", (base if i % 2 else "http://p.example/") + f"v{i}#n", f"http://once.example/{i}"))
    assert as_set(read_turtle(spark, str(tmp_path)).select("s", "p", "o")) == want


def test_long_run_of_relative_bases(spark, tmp_path):
    steps = 2_500
    text = "<a> <x:p> <x:o> .\n@base <y/> .\n@base <http://b.example/0/> .\n"
    text += "".join(f"@base <../{i}/> .\n" for i in range(1, steps)) + "<s> <x:p> '''o''' .\n"
    (tmp_path / "run.ttl").write_text(text)
    found = read_turtle(spark, str(tmp_path), on_reject="count")
    assert as_set(found.select("s", "o")) == {(f"http://b.example/{steps - 1}/s", "o")}


def test_lines_that_need_no_second_look(spark):
    """Statements of flat files are told to be harmless by one expression, and their bindings are found."""
    from trilake.sources.turtle import _PLAIN

    plain = [':s :p "a # [b] \'c\'"@en .', ":s a :T ;", ':s :p "1"^^xsd:integer .']
    looked_at = [':s :p "a" . # x .', ':s :p "a\\"" .', ":s :p [ :q :r ] .", ":s :p 'x' .", ':s :p """x .', "<a#b> :p :o ."]
    lines = spark.createDataFrame([(x,) for x in plain + looked_at], "value string")
    assert as_set(lines.where(lines.value.rlike(_PLAIN))) == {(x,) for x in plain}
