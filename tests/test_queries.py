"""Every registered query runs, and those with SQL give the rows DuckDB gives."""

import os

import duckdb
import pytest
from tables import TESTDATA

import __spark_entry__ as registered

TABLES = [f[: -len(".parquet")] for f in os.listdir(TESTDATA)] if os.path.isdir(TESTDATA) else []
QUERIES, SQL = registered.queries(), registered.oracle_sql()

pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{TESTDATA}/{table}.parquet'")
    return connection


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    rows = _sorted(df.collect(), df.columns)
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = _sorted(result.fetchall(), names)
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected):
        for g, w in zip(got, want):
            assert g == pytest.approx(w, rel=1e-6, abs=1e-6) if isinstance(w, float) else g == w
