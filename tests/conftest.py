import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trilake.session import session as make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = make_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def graph_of(spark):
    """Triples from short rows ``(s, p, o)``; an object in quotes is a literal."""
    from trilake.functions.terms import iri
    from trilake.vocab import TRIPLES

    def build(rows, g=None):
        out = []
        for s, p, o in rows:
            lexical, _, suffix = o[1:].rpartition('"') if o.startswith('"') else ("", "", "")
            if o.startswith('"'):
                dtype = iri(suffix[2:]) if suffix.startswith("^^") else None
                lang = suffix[1:] if suffix.startswith("@") else None
                out.append((iri(s), iri(p), lexical, "literal", dtype, lang, g))
            else:
                out.append((iri(s), iri(p), iri(o), "bnode" if o.startswith("_:") else "iri", None, None, g))
        return spark.createDataFrame(out, TRIPLES)

    return build


def as_set(df):
    return {tuple(r) for r in df.collect()}
