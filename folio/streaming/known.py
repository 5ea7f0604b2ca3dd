"""Keys that earlier batches brought, kept so that a batch reads little of them.

Keys lie as two hashes of 64 bits in ``keys/bucket=B/batch=N``. Beside them stands a Bloom filter as a table of ``words`` rows at most, each with 64
bits: a key sets four bits of the one word that its hash names. The filter's size is a parameter and doesn't grow with the history. A batch joins it by broadcast
(its number of rows is checked by what it is), and only keys whose four bits are all set may be known; only the buckets of
these are opened, as partitions of the scan, and decide. So new keys are mostly settled by the filter alone. A history that fills the filter makes batches read more and loses no
duplicate; a store with more words is then the remedy.

What a batch adds is numbered by the batch: a batch that runs again after a failure doesn't see itself and replaces what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.scratch import cut

#: Rows of the filter at most (16 bytes each), and buckets of the keys.
WORDS, BUCKETS = 1 << 18, 256
#: Filters of so many batches are kept, so that the last batches can run again.
KEPT = 3


class Known:
    """Keys of earlier batches, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, words: int = WORDS, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.words, self.buckets = spark, path.rstrip("/"), words, buckets

    def _batches(self, name: str) -> list[int]:
        """Numbers of the batches written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        folders = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
        whole = [p for p in folders if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in whole)

    def _hashed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows with h1 and h2; null if any of the keys is."""
        null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        one, two = F.xxhash64(*keys), F.xxhash64(F.lit("known"), *keys)
        return rows.withColumn("_h1", F.when(~null, one)).withColumn("_h2", F.when(~null, two))

    def _word(self) -> Column:
        return F.pmod(F.col("_h1"), F.lit(self.words)).cast("int")

    def _bits(self) -> Column:
        bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {6 * k}) & 63 as int))")
        return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(4)))

    def _bucket(self) -> Column:
        return F.pmod(F.shiftright("_h1", 24), F.lit(self.buckets)).cast("int")

    def unseen(self, rows: DataFrame, keys: list[str], before: int) -> DataFrame:
        """The rows whose keys no batch below ``before`` brought; rows with a null key are all unseen."""
        earlier = [n for n in self._batches("filter") if n < before]
        if not earlier:
            return rows
        bits = self.spark.read.parquet(f"{self.path}/filter/batch={earlier[-1]}").withColumnsRenamed({"word": "_word", "bits": "_set"})
        hashed = self._hashed(rows, keys).withColumn("_word", self._word())
        asked = hashed.where("_h1 is not null").join(F.broadcast(bits), "_word").where(F.col("_set").bitwiseAND(self._bits()) == self._bits())
        maybe = cut(asked.select("_h1", "_h2", self._bucket().alias("bucket")).distinct())
        opened = [r[0] for r in maybe.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not opened:
            return rows
        stored = self.spark.read.schema("h1 long, h2 long, batch int, bucket int").parquet(f"{self.path}/keys").where(F.col("bucket").isin(opened) & (F.col("batch") <= earlier[-1]))
        known = maybe.join(stored, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")) & (maybe["bucket"] == stored["bucket"]), "left_semi")
        return hashed.drop("_word").join(known.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti").select(*rows.columns)

    def add(self, rows: DataFrame, keys: list[str], number: int) -> None:
        """Keep the keys of batch ``number``; its filter is written last."""
        hashed = self._hashed(rows.select(*keys), keys).where("_h1 is not null")
        own = hashed.select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), F.lit(number).alias("batch"), self._bucket().alias("bucket")).distinct()
        placed = own.repartition("bucket").sortWithinPartitions("bucket", "h1")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/keys")
        earlier = [n for n in self._batches("filter") if n < number]
        new = hashed.select(self._word().alias("word"), self._bits().alias("bits"))
        if earlier:
            new = new.unionByName(self.spark.read.parquet(f"{self.path}/filter/batch={earlier[-1]}"))
        new.groupBy("word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(f"{self.path}/filter/batch={number}")
        for old in earlier[: -(KEPT - 1)]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filter/batch={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
