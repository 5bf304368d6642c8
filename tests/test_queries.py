"""Every query with SQL against DuckDB on the smallest tables; the rest must run and keep its columns."""

import glob
import math
import os

import duckdb
import pytest

from attestra.plans import all_registries

QUERIES = {n: q for r in all_registries() for n, q in r.queries.items()}
SQL = {n: s for r in all_registries() for n, s in r.sql.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    want = sorted(repr([plain(r[theirs.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    first = QUERIES[name](spark, small)
    assert first.columns and first.count() >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    result = driver.entry(spark)
    assert result.count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())
