"""Queries of the subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from scorewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    plain = lambda v: round(v, 3) if isinstance(v, float) else v
    left = sorted(repr([plain(r[n]) for n in names]) for r in got.collect())
    at = [want.columns.index(n) for n in names]
    assert left == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
