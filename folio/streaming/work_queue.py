"""A queue of documents to work off: first come first served, one document's failure stops no other, failed ones are tried again.

The queue is a stream of jobs, and its state is what is still to be tried again: a job that fails waits in the state store until a timer calls it (all of a document's waiting jobs together), as
often as ``attempts`` allows, and then leaves as an error. Everything else leaves as soon as it is done. Batches take jobs in the order in
which they arrive (``maxFilesPerTrigger`` and the like say how many at a time), a document's own jobs go in order of ``seq``. Results and state are kept together by
the checkpoint, so a restart neither repeats a finished job nor forgets a waiting one.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

RESULT = "seq long, attempts int, result string, error string"
STATES = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Worker(StatefulProcessor):
    """Tries a document's jobs; those that wait for another try are its state, by seq."""

    def __init__(self, make_work: Callable[[], Callable[[dict], str]], columns: list[str], schema: StructType, attempts: int, wait: float) -> None:
        self.make_work, self.columns, self.attempts, self.wait = make_work, columns, attempts, wait
        self.kept = StructType([*schema.fields, StructField("_attempts", IntegerType()), StructField("_error", StringType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.work = handle, None
        self.waiting = handle.getMapState("waiting", StructType([StructField("seq", LongType())]), self.kept)

    def _try(self, key: Any, job: dict, before: int, now: int) -> Iterator[Row]:
        error = result = None
        try:
            self.work = self.work or self.make_work()
            result = self.work(job)
        except Exception as e:  # this document's failure is its own
            error = f"{type(e).__name__}: {e}"
        tries, seq = before + 1, (job["seq"],)
        if error is not None and tries < self.attempts:
            self.waiting.updateValue(seq, (*(job[c] for c in self.columns), tries, error))
            self.handle.registerTimer(now + int(self.wait * 1000))
            return
        self.waiting.removeKey(seq)
        yield Row(**{self.columns[0]: key, "seq": job["seq"], "attempts": tries, "result": result, "error": error})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r.seq):  # of one document in one batch
            yield from self._try(key[0], row.asDict(), 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        waiting = sorted((tuple(v) for _, v in self.waiting.iterator()), key=lambda v: v[self.columns.index("seq")])
        for *values, tries, _ in waiting:
            yield from self._try(key[0], dict(zip(self.columns, values, strict=True)), tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocksdb(spark):
    """A query takes the settings of its start along; the session's come back."""
    name, provider = STATES
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def work_off(jobs: DataFrame, make_work: Callable[[], Callable[[dict], str]], attempts: int = 3, wait: float = 60) -> DataFrame:
    """doc_id, seq, attempts, result and error of each job (doc_id, seq, ...) of a stream, once it is done or has failed ``attempts`` times.

    ``make_work`` is called once for each task and gives a function of a job (a dict of all its columns) to a text. ``wait`` are the seconds to the next try. seq tells a document's jobs apart.
    """
    jobs = jobs.select("doc_id", *(c for c in jobs.columns if c != "doc_id"))
    worker = Worker(make_work, jobs.columns, jobs.schema, attempts, wait)
    schema = f"doc_id {dict(jobs.dtypes)['doc_id']}, {RESULT}"
    return jobs.groupBy("doc_id").transformWithState(worker, schema, "append", "processingTime")


def start(results: DataFrame, target: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Write the results of ``work_off`` to Parquet below ``target``, until the query is stopped."""
    with _rocksdb(results.sparkSession):
        return results.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drained(query: StreamingQuery, most: float = 600) -> bool:
    """Wait until all that has arrived is done and nothing waits for another try; false after ``most`` seconds."""
    end, idle = time.time() + most, set()
    while time.time() < end and query.isActive:
        progress = query.lastProgress  # batches go on without jobs, as timers may be due
        if progress is not None:
            quiet = not progress.numInputRows and all(not s.numRowsTotal for s in progress.stateOperators)
            idle = idle | {progress.batchId} if quiet else set()
            if len(idle) > 2:  # the first one after a restart may be an old batch, planned before jobs arrived
                return True
        time.sleep(0.1)
    if not query.isActive and query.exception() is not None:
        raise query.exception()
    return False


def outcome(results: DataFrame) -> DataFrame:
    """Column state of written results: done, or error."""
    return results.withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("error"))
