"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
import oracle
from trilake.plans import oracles, registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert oracle.differences(registry.queries()[name](spark, sf_dir), con, oracles.ORACLE[name]) == []


def test_every_twin_has_a_query():
    assert set(oracles.ORACLE) == set(NAMES)
    assert set(NAMES) <= set(contract.queries()) and set(NAMES) <= set(contract.oracle_sql())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and contract.entry(spark).columns == ["country", "segment", "customers", "orders", "revenue"]
