"""Each query against its own SQL in DuckDB."""

import os

import duckdb
import pytest

from folio import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({q.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(str, want)) and got
