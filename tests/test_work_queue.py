"""The work queue with failing documents, and after a restart."""

import os

from folio.streaming.work_queue import drained, outcome, start, work_off

JOBS = "doc_id string, seq long, name string"


def logged_work(log):
    """Notes each try; ``bad`` fails always, ``flaky`` once."""

    def make():
        def work(job):
            path = f"{log}/{job['doc_id']}-{job['seq']}"
            with open(path, "a") as f:
                f.write("x")
            if job["name"] == "bad" or job["name"] == "flaky" and os.path.getsize(path) == 1:
                raise ValueError(f"no {job['name']}")
            return job["name"].upper()

        return work

    return make


def run(spark, tmp_path):
    jobs = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "land"))
    query = start(work_off(jobs, logged_work(str(tmp_path / "log")), attempts=3, wait=0.5), str(tmp_path / "out"), str(tmp_path / "ck"), "0.2 seconds")
    try:
        assert drained(query, 120)
    finally:
        query.stop()
    return {(r.doc_id, r.seq): (r.attempts, r.result, r.error, r.state) for r in outcome(spark.read.parquet(str(tmp_path / "out"))).collect()}


def tries(tmp_path):
    return {n: len((tmp_path / "log" / n).read_text()) for n in os.listdir(tmp_path / "log")}


def test_failing_documents_stop_no_other_and_a_restart_repeats_nothing(spark, tmp_path):
    (tmp_path / "log").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put = lambda rows: spark.createDataFrame(rows, JOBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    put([("a", 1, "one"), ("a", 2, "two"), ("b", 3, "bad"), ("c", 4, "flaky"), (None, 5, "null")])
    want = {("a", 1): (1, "ONE", None, "done"), ("a", 2): (1, "TWO", None, "done"), ("b", 3): (3, None, "ValueError: no bad", "error"), ("c", 4): (2, "FLAKY", None, "done"), (None, 5): (1, "NULL", None, "done")}
    assert run(spark, tmp_path) == want
    assert tries(tmp_path) == {"a-1": 1, "a-2": 1, "b-3": 3, "c-4": 2, "None-5": 1}
    put([("a", 6, "six"), ("d", 7, "bad")])
    want |= {("a", 6): (1, "SIX", None, "done"), ("d", 7): (3, None, "ValueError: no bad", "error")}
    assert run(spark, tmp_path) == want
    assert tries(tmp_path) == {"a-1": 1, "a-2": 1, "b-3": 3, "c-4": 2, "None-5": 1, "a-6": 1, "d-7": 3}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
