"""The numbered queries against their SQL, and the pipeline against its own stages."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from trilake.llm import registry  # noqa: E402

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = oracle.connect(sf_dir)
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
