"""Keys beyond those of the small tables, where made-up numbers look like something else."""

import duckdb
from pyspark.sql import functions as F

from folio import queries
from folio.functions import registry_numbers as R


def against_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want) and len(want) == len(rows)


def test_official_gate_takes_no_id_for_a_province_number(spark, tmp_path):
    keys = range(27_780, 28_040)  # ids that start with 319 to 322
    against_sql(spark, tmp_path, "q_official_gate", "customer", [(k,) for k in keys], "c_custkey long")


def test_province_number_with_misread_stroke(spark):
    texts = ["32/12345", "32112345", "32|1234", "321 12345", "32112345678", "No: 32198765432"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(R.PROVINCE).alias("x")).collect()
    assert [r.x for r in found] == [True, True, True, True, False, False]


def test_prefix_elim_at_all_nines(spark, tmp_path):
    against_sql(spark, tmp_path, "q_prefix_elim", "orders", [(k,) for k in (89_998, 89_999, 90_000, 989_999, 79_999, 0, 7)], "o_orderkey long")
