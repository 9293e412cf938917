"""Each query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def told(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([told(v) for v in value])
    if isinstance(value, bool):
        return str(value)
    return str(value)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(SQL[name])
    assert columns == sorted(theirs.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in mine.collect())
    at = [theirs.columns.index(c) for c in columns]
    assert got == sorted(tuple(told(r[i]) for i in at) for r in theirs.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["line"] and df.count() > 0
