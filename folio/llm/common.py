"""What the operators share: the shared work folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator broadcasts (after counting it).
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a single-JVM session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


#: Has Spark delete a write's shuffle files when it is done; what is written doesn't need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_scratch", default=None)


def materialize(df: DataFrame, scratch: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Within ``scratch_tables`` the folder goes at its end, unless ``scratch`` is false.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    if scratch and (own := _scratch.get()) is not None:
        own.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once nothing reads it any more."""
    for df in written:
        for file in df.inputFiles()[:1]:
            if "/folio-" in (folder := file.rsplit("/", 1)[0]):
                delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``materialize`` wrote meanwhile; a frame that still reads it must have been written by then."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            delete(spark, path)
        _scratch.reset(token)


#: Rows of an Arrow batch of texts. A batch stands in memory several times over, in the executor and in its Python worker.
BATCH_ROWS, BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session cut Arrow batches at ``BATCH_ROWS`` rows, unless it was told another number than Spark's own."""
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, str(BATCH_ROWS))
    return df


BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Meanwhile the session cuts Arrow batches at ``size`` bytes, too."""
    before = spark.conf.get(BATCH_SIZE)
    spark.conf.set(BATCH_SIZE, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SIZE, before)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``rows`` rows; else the planner picks a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text):
    """Lower-case A-Z and nothing else; texts of ASCII alone take the faster built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
