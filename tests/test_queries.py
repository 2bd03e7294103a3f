"""Every query with an SQL equivalent has its rows (as the driver compares them)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tremorlake.plans import catalog_queries as C
from tremorlake.plans import file_queries as T

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(C.ORACLE | T.ORACLE))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    rel = duck.sql((C.ORACLE | T.ORACLE)[name])
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert len(want[1]) > 0
