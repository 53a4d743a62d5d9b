"""Every registered query with SQL gives the same rows in both engines, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom import catalog

FOLDER = os.environ.get("LEDGERLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, engine, name):
    frame = catalog.queries()[name](spark, FOLDER)
    names = sorted(frame.columns)
    got = sorted(key(r[c] for c in names) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        rel = engine.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        assert got == sorted(key(r[i] for i in at) for r in rel.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
