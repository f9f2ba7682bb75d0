"""Every registered query gives the rows of its SQL definition."""

import pytest
from oracle_check import compare, connect

from partner_analytics.catalog import load

SF_DIR = "/root/testdata/sf0.001"
ENTRIES = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", list(ENTRIES))
def test_query_matches_definition(key, spark, duck):
    rows, problem = compare(ENTRIES[key], spark, duck, SF_DIR)
    assert problem is None, problem


def test_every_query_has_a_definition():
    assert [k for k, e in ENTRIES.items() if e.oracle is None] == []


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
