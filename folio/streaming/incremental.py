"""Incremental arrival: duplicates across runs, plans per batch, readings only where a field is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.streaming.known import Known


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; on a stream use drop_known, which keeps state instead."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def drop_known(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A stream without rows whose keys have come before; the checkpoint keeps all keys for good, so this is for key sets that stay small. ``run_batches`` needs no such state."""
    return stream.dropDuplicates(keys)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Plan all files that have arrived and stop; each batch goes to a folder of its own, so a batch that runs again after a failure replaces itself.

    With ``keys`` a batch's rows whose keys (not null) an earlier batch brought, or that repeat within it, are dropped first. The keys are kept beside
    the target, in ``_known`` (``known.Known``), of which a batch opens only what may hold its keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{target}/batch={number}"
        if not keys:
            plan(batch).write.mode("overwrite").parquet(folder)
            return
        known = Known(batch.sparkSession, f"{target}/_known")
        new = known.unseen(batch.dropDuplicates(keys), keys, before=number).persist()
        try:
            plan(new).write.mode("overwrite").parquet(folder)
            known.add(new, keys, number)
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fill_gaps(fields: DataFrame, field: str, reader, schema: str) -> DataFrame:
    """Fill empty values of a field from a reader (mapInPandas function of doc_id): only rows that need it reach the reader, and what OCR gave is never overwritten."""
    empty = fields.where(F.coalesce(F.col(field), F.lit("")) == "")
    read = empty.select("doc_id").mapInPandas(reader, schema).withColumnRenamed("value", "_read")
    filled = empty.join(read, "doc_id", "left").withColumn(field, F.coalesce(F.col("_read"), F.lit(""))).drop("_read")
    return fields.where(F.coalesce(F.col(field), F.lit("")) != "").unionByName(filled)


def reading_key(prompt: Column, image: Column) -> Column:
    """The key under which a reading of an image is kept: the first 32 hex digits of a hash of both."""
    return F.substring(F.sha2(F.concat(prompt.cast("binary"), image), 256), 1, 32)


def read_once(wanted: DataFrame, cache: DataFrame, reader, schema: str) -> DataFrame:
    """Rows (key, value) for ``wanted``, from the cache where it has them; only the other keys, once each, reach the reader (a mapInPandas function of wanted's columns)."""
    new = wanted.join(cache, "key", "left_anti").dropDuplicates(["key"])
    return cache.join(wanted.select("key").distinct(), "key", "left_semi").select("key", "value").unionByName(new.mapInPandas(reader, schema).select("key", "value"))
