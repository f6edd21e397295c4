"""Every registered query against its SQL twin on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from scans import scans

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = canonical(df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in SQL:
        assert got
        return
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert got == canonical(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["method_share", "country_engagement"])
def test_shares_read_the_facts_once(spark, name):
    found = [rows for place, rows in scans(QUERIES[name](spark, FOLDER)) if place.endswith("events.parquet")]
    assert len(found) == 1 and found[0] > 0
