"""Steps that several later ones read are computed once."""

import re

from folio import queries

SF = "/root/testdata/sf0.001"


def test_plan_reads_its_documents_from_what_was_written(spark):
    found = queries.queries()["q_plan_actions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in found


def test_label_work_reads_its_pages_from_what_was_written(spark):
    found = queries.queries()["q_label_work"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in found


def test_split_names_deals_its_pages_to_tasks_of_so_many_rows(spark, monkeypatch):
    """At 1,000 rows a task the pages of sf0.001 take six or more partitions, through the join and all steps; nothing is dealt anew."""
    from folio.sources import scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = queries.queries()["q_split_names"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(\S+, (\d+)\), (\w+)", plan)
    assert len(dealt) > 3 and set(dealt) == {(str(-(-lines // 1000)), "REPARTITION_BY_NUM")}, dealt
    assert found.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
