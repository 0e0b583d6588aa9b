"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from scorewright.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return str(v)
    return v if isinstance(v, (str, list)) else float(v) if hasattr(v, "__float__") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLES:
        assert got.columns
        return
    want = duck.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(n) for n in names]
    left = sorted(repr([plain(r[n]) for n in names]) for r in rows)
    right = sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
    assert left == right
