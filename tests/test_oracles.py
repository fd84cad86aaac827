"""Every query with SQL against DuckDB on the smallest tables; the others must run and repeat."""

import math
import os

import duckdb
import pytest

from isobath.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def cell(x):
    if x is None or x != x:
        return "~"
    if hasattr(x, "year"):
        return str(x)[:10]
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{float(x):.4f}" if math.isfinite(float(x)) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    wanted = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    columns = sorted(df.columns)
    got = sorted([cell(r[c]) for c in columns] for r in df.collect())
    place = [wanted.columns.index(c) for c in columns]
    expected = sorted([cell(r[i]) for i in place] for r in wanted.fetchall())
    assert len(got) == len(expected)
    assert sum(a != b for a, b in zip(got, expected, strict=True)) == 0


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_repeats_itself(spark, name):
    query = catalogue.queries()[name]
    first, second = ([str(r) for r in query(spark, SF).collect()] for _ in range(2))
    assert sorted(first) == sorted(second)
