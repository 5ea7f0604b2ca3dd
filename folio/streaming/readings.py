"""Reading documents page by page, in rounds that read no page in vain.

A reader may only look at a document's pages until it has ``READINGS`` readings that aren't empty. A document that still lacks n of them
will have its next n pages read whatever they say, so a round reads just these, of all open documents at once; what
it gave is written before the next round begins, and documents that have enough, or no page left, are open no more. So the pages read are those that a loop
over the pages would read, and a run that is stopped goes on behind its last whole round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import normalize, strip
from folio.operators.votes import READINGS, consensus

SCHEMA = "doc_id {id}, page_no {page}, value string, error string"
#: What a round's folder holds besides: the page's place, and how many readings its document had before the round.
STATE = ("place", "_got")


def readable(pages: DataFrame, blank: Column, box: Column) -> DataFrame:
    """Pages that are read at all, with their place in the document: not blank, and with a label's box."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    return pages.where(~F.coalesce(blank, F.lit(False)) & box.isNotNull()).withColumn("place", F.row_number().over(order))


def _folder(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a round was written to its end, with what the next one goes by."""
    path, files = _folder(spark, f"{folder}/_SUCCESS")
    return files.exists(path) and set(STATE) <= set(spark.read.parquet(folder).columns)


def _reading(make_reader: Callable[[], Callable[[dict], str]], columns: list[str]):
    """Rows through a reader that is made once for each task; what it raises is kept beside an empty value."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            values, errors = [], []
            for row in zip(*(batch[c] for c in columns), strict=True):
                try:
                    reader = reader or make_reader()
                    value, error = reader(dict(zip(columns, row, strict=True))) or "", None
                except Exception as e:  # a page that can't be read is a result, not the end of the others
                    value, error = "", f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield batch[["doc_id", "page_no"]].assign(value=pd.Series(values, dtype=object), error=pd.Series(errors, dtype=object), **{c: batch[c] for c in STATE})

    return read


def read_in_rounds(pages: DataFrame, make_reader: Callable[[], Callable[[dict], str]], path: str, most: int = READINGS) -> DataFrame:
    """(doc_id, page_no, value, error) of every page that was read, from what ``readable`` returns.

    ``make_reader`` is called once for each task and gives a function of a row (all columns of pages, as a dict) to a text. Null and blank texts, and pages on which it
    fails, count as empty: the document goes on with its next page. Values are normalised. ``path`` keeps a folder for each round and must be one
    that all executors share; a folder that an earlier run has written to its end isn't read again.

    A round only looks at the documents of the round before and at the places that are still to come: the first one reads ``most`` pages of
    a document and each later one at least one.
    """
    spark, kinds = pages.sparkSession, dict(pages.dtypes)
    schema = SCHEMA.format(id=kinds["doc_id"], page=kinds["page_no"])
    with_state = f"{schema}, place int, _got long"
    done, last, k = spark.createDataFrame([], schema), None, 0
    while True:
        folder = f"{path}/round={k}"
        if not _is_whole(spark, folder):
            if last is None:
                wanted = pages.where((F.col("place") > 0) & (F.col("place") <= most)).withColumn("_got", F.lit(0).cast("long"))
            else:
                got = F.max("_got") + F.count_if(F.col("value") != "")
                open_ = last.groupBy("doc_id").agg(F.max("place").alias("_seen"), got.alias("_got")).where(F.col("_got") < most)
                wanted = pages.where(F.col("place") > most + k - 1).join(open_, "doc_id")
                wanted = wanted.where((F.col("place") > F.col("_seen")) & (F.col("place") <= F.col("_seen") + most - F.col("_got")))
            read = wanted.select(*pages.columns, "_got").mapInPandas(_reading(make_reader, pages.columns), with_state)
            read.withColumn("value", F.when(strip(F.col("value")) == "", F.lit("")).otherwise(normalize(F.col("value")))).write.mode("overwrite").parquet(folder)
        last = spark.read.schema(with_state).parquet(folder)
        if last.isEmpty():
            return done
        done, k = done.unionByName(last.drop(*STATE)), k + 1


def read_and_vote(pages: DataFrame, make_reader: Callable[[], Callable[[dict], str]], path: str, most: int = READINGS) -> DataFrame:
    """(doc_id, majority, votes, agreed) of the documents with a reading."""
    return consensus(read_in_rounds(pages, make_reader, path, most).select("doc_id", "page_no", "value"))
