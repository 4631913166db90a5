import datetime

from pyspark.sql import functions as F

from trilake.functions import terms, values
from trilake.vocab import NS, RDF, RDFS, XSD, XSD_DATE, XSD_DOUBLE, XSD_INTEGER


def column(spark, items, fn):
    df = spark.createDataFrame([(x,) for x in items], "x string").coalesce(1)
    return [r.y for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_expand_takes_the_whole_prefix(spark):
    names = ["rdfs:label", "rdf:type", ":C1", "xsd:date", "nope:x", "plain", ":a:b"]
    wanted = [RDFS + "label", RDF + "type", NS + "C1", XSD + "date", "nope:x", "plain", NS + "a:b"]
    assert column(spark, names, terms.expand) == wanted
    assert [terms.iri(n) for n in names] == wanted
    assert terms.iri("<http://b/x>") == "http://b/x" and terms.iri("http://b/x") == "http://b/x"


def test_compact_is_the_inverse_where_there_is_a_prefix(spark):
    full = [RDFS + "label", NS + "C1", NS + "g/x", "http://other/x", NS, NS + "a.b"]
    assert column(spark, full, terms.compact) == [
        "rdfs:label", ":C1", f"<{NS}g/x>", "<http://other/x>", f"<{NS}>", f"<{NS}a.b>",
    ]


def test_compact_with_nested_and_open_ended_namespaces(spark):
    prefixes = {"a": "http://x/", "ab": "http://x/y/", "n": "http://x/n-"}
    full = ["http://x/1", "http://x/y/1", "http://x/n-1"]
    assert column(spark, full, lambda c: terms.compact(c, prefixes)) == ["a:1", "ab:1", "n:1"]


def test_template_keeps_long_numbers(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "n bigint").coalesce(1)
    made = [r[0] for r in df.select(terms.iri_template("C", F.col("n"), 6)).collect()]
    assert made == ["C000007", "C1234567"]


def test_literal_split_at_the_last_marker(spark):
    items = ['"5"^^xsd:integer', '"plain"', '"a^^xsd:b"^^xsd:date', ":iri"]
    split = column(spark, items, terms.literal_split)
    assert [(s.lex, s.dtype) for s in split] == [
        ('"5"', XSD_INTEGER), ('"plain"', None), ('"a^^xsd:b"', XSD_DATE), (":iri", None),
    ]


def test_malformed_values_are_unbound(spark):
    assert column(spark, ["1.5", "abc", "1e2"], lambda c: terms.term_value(c, XSD_DOUBLE)) == [1.5, None, 100.0]
    assert column(spark, ["12", "1.5x", ""], lambda c: terms.term_value(c, XSD_INTEGER)) == [12, None, None]
    assert column(spark, ["2024-02-29", "2023-02-29"], lambda c: terms.term_value(c, XSD_DATE)) == [
        datetime.date(2024, 2, 29), None,
    ]


def test_local_name(spark):
    assert column(spark, [RDFS + "label", NS + "C1", "http://b/a#b/c", "urn:x"], terms.local_name) == [
        "label", "C1", "c", "urn:x",
    ]


def test_escapes_are_undone_by_unescape(spark):
    items = ['q " b \\ n \n r \r t \t', "\\n is not a newline", "é 😀", ""]
    assert column(spark, items, lambda c: terms.unescape(terms.escape_literal(c))) == items
    assert column(spark, items, lambda c: terms.unescape(terms.escape_iri(c))) == items


def test_sentinels(spark):
    items = ["1.234567", "TIMEOUT", "N/A", "ERROR", "FAILED", None, "7"]
    assert column(spark, items, values.clean_seconds) == [1.23457, None, None, None, None, None, 7.0]


def test_mapped_default(spark):
    assert column(spark, ["a", "b"], lambda c: values.mapped(c, {"a": 1}, 0)) == [1, 0]
