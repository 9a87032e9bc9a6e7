"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from gemello import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = db.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    want = sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_lists_what_is_there():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)
