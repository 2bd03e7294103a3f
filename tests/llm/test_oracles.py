"""Queries that SQL can express, against DuckDB on the whole of the smallest tables."""

import glob
import os

import duckdb
import pytest

from tremorlake.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
