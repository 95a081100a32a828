"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

from __future__ import annotations

import os

import pytest

from presswerk.plans import registry

D = os.environ.get("PRESSWERK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(registry.ORACLES[name])
    assert got == rows([x[0] for x in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert {"batch_plan", "upsert_replace"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
