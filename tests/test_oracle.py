"""Every query with SQL gives the same rows in DuckDB; the entry module is complete."""

import pytest

import __spark_entry__ as entry_module
from dataloom.queries import all_queries, all_sql
from oracle import connect, differences, duck_rows, spark_rows

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = spark_rows(QUERIES[name](spark, folder))
    assert got[1], "no rows"
    if name in SQL:
        assert differences(got, duck_rows(con, SQL[name])) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() == 6


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
