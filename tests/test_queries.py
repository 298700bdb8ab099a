"""Every registered query with SQL gives what the SQL gives; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{data}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    rows = got.collect()
    if name in SQL:
        ref = con.sql(SQL[name])
        assert sorted(got.columns) == sorted(ref.columns)
        assert rows_of(got.columns, rows) == rows_of(ref.columns, ref.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
