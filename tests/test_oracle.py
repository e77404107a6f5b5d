"""Every registered query against its DuckDB oracle on the smallest test
folder (the driver runs the same comparison at sf0.01)."""

import os

import pytest

from compare import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from churnlens.plans.catalog import QUERIES
    return list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def oracle():
    from churnlens.plans.oracle import ORACLE_SQL
    return ORACLE_SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, oracle, name):
    from churnlens.plans.catalog import QUERIES
    ok, msg = compare(QUERIES[name](spark, SF), con, oracle[name])
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as e
    from churnlens.plans.catalog import QUERIES
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["segment", "customer_count", "avg_monetary", "total_revenue"]
    assert df.count() >= 0
