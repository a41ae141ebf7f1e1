"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle import compare, duck
from pomelo.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "NDCG" in df.columns
