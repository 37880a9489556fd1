"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexforge.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert got == sorted(duck.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall(), key=str)
