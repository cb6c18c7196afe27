"""Every registered query with SQL equals DuckDB on the smallest tables; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], SQL.get(name), SF)
    assert ok, note


def test_sql_has_a_query_each():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "pos", "id", "page_path", "start_line", "end_line", "title", "score", "rank"]
    assert rows.count() > 0
