"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single-JVM session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Rows of pages that one task sorts; a row may grow to some hundred bytes and be sorted twice.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Partitions that hold ``TASK_ROWS`` rows at most where keys are even, so that a task's memory doesn't grow with the table; one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder as compressed columns and read back; later reads take only the columns and rows that they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder, so that what follows neither repeats it nor loses it with an executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
