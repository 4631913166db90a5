import pytest
from conftest import as_set

from trilake.sinks.rdf import ntriples_lines, write_ntriples
from trilake.sources.files import file_count, load_stats, read_files
from trilake.sources.ntriples import read_ntriples, scan_ntriples
from trilake.vocab import XSD_DOUBLE

S, P = "<http://b/s>", "<http://b/p>"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def objects(spark, path):
    return {(r.o, r.o_kind, r.o_dtype, r.o_lang) for r in read_ntriples(spark, path).collect()}


@pytest.mark.parametrize(
    "term, expected",
    [
        (r'"a \" . b"@en-GB', ('a " . b', "literal", None, "en-GB")),
        (f'"12.5"^^<{XSD_DOUBLE}>', ("12.5", "literal", XSD_DOUBLE, None)),
        ('""', ("", "literal", None, None)),
        (r'"café \n \t \\n"', ("café \n \t \\n", "literal", None, None)),
        (r'"\U0001F600 \\U0001F600"', ("😀 \\U0001F600", "literal", None, None)),
        (r'"it\'s"', ("it's", "literal", None, None)),
        ('"x"^^<http://www.w3.org/2001/XMLSchema#string>', ("x", "literal", None, None)),
        ("<http://b/o>", ("http://b/o", "iri", None, None)),
        (r"<http://b/é>", ("http://b/é", "iri", None, None)),
        ("<http://b/a#b>", ("http://b/a#b", "iri", None, None)),
    ],
)
def test_terms(spark, tmp_path, term, expected):
    path = write(tmp_path / "a.nt", f"{S} {P} {term} . # note\n")
    assert objects(spark, path) == {expected}


@pytest.mark.parametrize(
    "line",
    [
        "garbage",
        f"{S} {P} .",
        f'{S} {P} "open .',
        rf'{S} {P} "bad \q" .',
        rf'{S} {P} "lone \ud83d" .',
        rf'{S} {P} "beyond \U00110000" .',
        f"{S} {P} <http://b/a b> .",
        f'"s" {P} "o" .',
        f"{S} _:b0 <http://b/o> .",
        f"{S} {P} <http://b/o>",
    ],
)
def test_malformed_lines_are_rejected(spark, tmp_path, line):
    path = write(tmp_path / "a.nt", line + "\n")
    assert tuple(load_stats(scan_ntriples(spark, path)).first()) == (0, 0, 1)


def test_comments_blank_lines_and_repeats(spark, tmp_path):
    path = write(tmp_path / "a.nt", f"# c\n\n  # c\n{S} {P} {S} .\n{S}{P}{S}.\n\t{S}\t{P}\t{S}\t.\r\nbad\n")
    assert tuple(load_stats(scan_ntriples(spark, path)).first()) == (3, 1, 1)
    assert read_ntriples(spark, path).count() == 1
    assert read_ntriples(spark, path, distinct=False).count() == 3


def test_load_stats_of_nothing(spark, tmp_path):
    path = write(tmp_path / "a.nt", "# nothing\n")
    assert tuple(load_stats(scan_ntriples(spark, path)).first()) == (0, 0, 0)


def test_very_long_literal(spark, tmp_path):
    text = r"line\n" * 200_000
    path = write(tmp_path / "a.nt", f'{S} {P} "{text}" .\n')
    assert read_ntriples(spark, path).first().o == "line\n" * 200_000


def test_blank_nodes_are_scoped_to_their_file(spark, tmp_path):
    for name in ("a.nt", "b.nt"):
        write(tmp_path / name, f"_:x {P} _:y .\n_:y {P} _:x.\n")
    rows = read_ntriples(spark, str(tmp_path)).collect()
    assert len(rows) == 4
    assert len({r.s for r in rows}) == 4 == len({r.o for r in rows} | {r.s for r in rows})
    assert all(r.s.startswith("_:") and r.o_kind == "bnode" for r in rows)


def test_files_by_glob_into_a_graph(spark, tmp_path):
    for name in ("one.nt", "two.nt", "three.txt"):
        write(tmp_path / name, f'{S} {P} "{name}" .\n')
    rows = read_files(spark, str(tmp_path), "*.nt", graph="http://b/g").collect()
    assert {(r.o, r.g) for r in rows} == {("one.nt", "http://b/g"), ("two.nt", "http://b/g")}
    assert file_count(spark, str(tmp_path), "*.nt").first().files == 2
    with pytest.raises(ValueError):
        read_files(spark, str(tmp_path), "*.nt", syntax="other")


def test_roundtrip_of_awkward_terms(spark, tmp_path, graph_of):
    graph = graph_of(
        [
            (":s", ":p", '"quote \\" and \\ and \n\r\t"'),
            (":s", ":p", '"plain"@de'),
            (":s", ":p", '"1"^^xsd:integer'),
            (":s", ":p", '" . "'),
            ("http://b/a b>", ":p", "http://b/{x}|^`\\"),
            ("_:n", ":p", '"😀"'),
        ]
    ).where("NOT s LIKE '\\_:%'")
    write_ntriples(graph, str(tmp_path / "out"))
    assert as_set(read_ntriples(spark, str(tmp_path / "out"))) == as_set(graph)
    assert not any("\n" in r.value for r in ntriples_lines(graph).collect())


def test_compressed_in_short_files(spark, graph_of, tmp_path):
    g = graph_of([(f":s{i}", ":p", '"a long text that is the same"') for i in range(1_000)]).coalesce(1)
    write_ntriples(g, str(tmp_path / "packed"), compression="gzip", maxRecordsPerFile=300)
    files = list((tmp_path / "packed").glob("part-*.gz"))
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < 20_000
    assert as_set(read_ntriples(spark, str(tmp_path / "packed"))) == as_set(g)
