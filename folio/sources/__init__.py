"""Readers and writers of scanned files, tables and JSON state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, recursive: bool = True, any_case: bool = False) -> DataFrame:
    """files(doc_id, source_path, file_name, file_sha256, content) of the PDFs below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{pdf,PDF}" if any_case else "*.pdf").load(folder)
    return found.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_sha256"), "content")


#: Ranges of an order that rows are numbered in.
RANGES = 128


def numbered(files: DataFrame, order: str = "source_path") -> DataFrame:
    """Column seq from 1 in the order of a column that isn't null; equal values are numbered in any order.

    Some values, chosen by hash, cut the order into ranges; a range's first number is the
    count of the rows before it, so no task gets all rows.
    """
    rows = files.drop("content")
    bounds = sorted(r[0] for r in rows.select(order).distinct().orderBy(F.xxhash64(order), order).limit(RANGES - 1).collect())
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = rows.withColumn("_range", place)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # RANGES rows at most
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return rows.join(F.broadcast(first), "_range").withColumn("seq", (F.col("_first") + number).cast("int")).drop("_range", "_first")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV with a header, all strings, missing cells as empty strings."""
    rows = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    return rows.na.fill("")


def write_csv(df: DataFrame, path: str, seq: str) -> None:
    df.orderBy(F.col(seq).cast("int")).write.csv(path, header=True, quoteAll=True, escape='"')


def read_json_map(spark: SparkSession, path: str, value: str = "map<string,string>") -> DataFrame:
    """(key, value) rows of a JSON object of objects, such as predictions by sequence number."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))

