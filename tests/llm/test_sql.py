"""Queries of operators that SQL can express, against that SQL in DuckDB."""

import os

import duckdb
import pytest

from folio.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want)) and want
