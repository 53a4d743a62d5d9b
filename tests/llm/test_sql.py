"""The SQL of the numbered queries gives their rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom.llm import queries

FOLDER = os.environ.get("LEDGERLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = queries.QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in frame.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())
