"""The queries and their SQL agree on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)[:19] if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_same_rows(spark, db, name):
    df, found = entry.queries()[name](spark, FOLDER), db.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
