"""Every named query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL

from tallyglass.plans import load
from tallyglass.plans.compare import compare, duck

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    if key in ORACLES:
        assert compare(df, con, ORACLES[key]) is None
    else:
        assert df.count() >= 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["category", "first_row", "l_extendedprice", "l_quantity"]
