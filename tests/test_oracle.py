import pytest

import __spark_entry__ as entry
from omiclattice.plans import catalog
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 190
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    """Only that it runs: its operator is compared with brute force elsewhere."""
    assert catalog.QUERIES[name](spark, SF).count() >= 0
