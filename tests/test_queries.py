"""Every registered query runs; those with SQL give the same rows."""

import pytest

import __spark_entry__ as entry
from tablelens.plans import load_all
from tests.compare import connect, differences

QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 11
