"""Votes over repeated readings of one field, and merging of two sources.

Null and empty readings don't vote; a document without any has no row. Readings of equal page number vote in any order.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from folio.functions.text import MARKED, UNMARKED, fold, merge_spelling, normalize, unmark

# Readings that vote, votes that agree, and the ratio from which two names are one person's.
READINGS, AGREED, SAME = 50, 2, 0.88
_PLAIN = str.maketrans(MARKED, UNMARKED)


def consensus(readings: DataFrame) -> DataFrame:
    """(doc_id, majority, votes, agreed) from (doc_id, page_no, value).

    Readings are grouped without their marks; the largest group wins, ties go to the one
    seen first. Each character of the winner is the group's most frequent one at its
    place, a marked letter before a plain one. agreed is empty below two votes.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    rows = readings.where("value <> ''").withColumn("n", F.row_number().over(order)).where(F.col("n") <= READINGS).withColumn("key", unmark(F.col("value")))
    groups = rows.groupBy("doc_id", "key").agg(F.count("*").alias("votes"), F.min("n").alias("first"))
    best = groups.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "first"))).where("r = 1").select("doc_id", "key", "votes")
    chars = rows.join(best, ["doc_id", "key"]).select("doc_id", "votes", "n", F.posexplode(F.split("value", "")).alias("pos", "ch"))
    chars = chars.groupBy("doc_id", "votes", "pos", "ch").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    top = Window.partitionBy("doc_id", "pos").orderBy(F.desc("c"), F.desc(unmark(F.col("ch")) != F.col("ch")), "first")
    chars = chars.withColumn("r", F.row_number().over(top)).where("r = 1")
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return chars.groupBy("doc_id", "votes").agg(name.alias("majority")).select("doc_id", "majority", "votes", F.when(F.col("votes") >= AGREED, F.col("majority")).otherwise(F.lit("")).alias("agreed"))


@F.pandas_udf(StringType())
def transfer_marks(read: pd.Series, ocr: pd.Series) -> pd.Series:
    """Marks of the OCR text put on the reading's plain letters where both run alike."""

    def one(a: str, b: str) -> str:
        out = list(a)
        for i, j, n in difflib.SequenceMatcher(None, a.translate(_PLAIN), b.translate(_PLAIN), autojunk=False).get_matching_blocks():
            for k in range(n):
                if a[i + k].translate(_PLAIN) == a[i + k] and b[j + k].translate(_PLAIN) != b[j + k]:
                    out[i + k] = b[j + k]
        return "".join(out)

    return pd.Series([one(a or "", b or "") for a, b in zip(read, ocr, strict=True)])


@F.pandas_udf(BooleanType())
def same_person(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two names' ratio of matching runs is ``SAME`` at least; false if either is null or empty. A batch compares each different pair once."""
    known: dict[tuple[str, str], bool] = {}

    def one(x: str | None, y: str | None) -> bool:
        if not x or not y:
            return False
        if (x, y) not in known:
            m = difflib.SequenceMatcher(None, x, y)
            known[x, y] = m.real_quick_ratio() >= SAME and m.quick_ratio() >= SAME and m.ratio() >= SAME  # the first two are upper bounds
        return known[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def merge_names(df: DataFrame, read: str, ocr: str) -> DataFrame:
    """Column merged: the reading, corrected by OCR. An empty side loses; only rows that differ in letters reach the UDF."""
    a, b = normalize(F.col(read)), normalize(F.col(ocr))
    df = df.withColumn("_a", a).withColumn("_b", b)
    settled = F.when(F.col("_a") == "", F.col("_b")).when(F.col("_b") == "", F.col("_a")).when(fold(F.col("_a")) == fold(F.col("_b")), merge_spelling(F.col("_a"), F.col("_b")))
    df = df.withColumn("merged", settled)
    done, rest = df.where("merged is not null"), df.where("merged is null")
    return done.unionByName(rest.withColumn("merged", transfer_marks("_a", "_b"))).drop("_a", "_b")


def same_name(a: Column, b: Column) -> Column:
    """Agreement of two methods: equal but for marks, spaces kept."""
    return unmark(normalize(a)) == unmark(normalize(b))
