"""Every registered query runs; those with SQL give its rows."""

import pytest
from oracle import connect, rows_in, rows_of

import __spark_entry__ as entry
from millrace.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, con, name):
    names, rows = rows_of(QUERIES[name](spark, small))
    assert (names, rows) == rows_in(con, SQL[name])
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "distance", "rank"]
    assert df.count() > 0


def test_registry_is_part_of_the_contract():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
