"""Every registered query with SQL gives that SQL's rows."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def shown(v):
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in found.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
