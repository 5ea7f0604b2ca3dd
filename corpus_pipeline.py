"""A training-data pipeline: language ID, near-duplicates, repeats, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one to
the shared folder and reads it again as the next one's docs. What a stage wrote on the way is deleted once its result stands.

Every stage keeps rows with a null id, reads texts of any length whole, ignores columns other than its
own (extra ones aren't returned, whatever their names), and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, langid, mixing, shingle_dedup, suffix_dedup
from folio.llm.common import broadcast_if_small, discard, materialize, read_table, scratch_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; lang becomes the predicted one.

    Null and empty texts, and those without a letter, go. Equal scores go to the language that sorts
    first. Rows that repeat stay. Without any text to learn from every document goes.
    """
    found = langid.predict(docs, langid.fit(docs), keep=["text", "source", "n_chars"])
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity of 0.8 or more, exactly) the document of least id stays.

    Texts without words, null ones too, are copies of each other. Of rows that repeat id and text one stays; different texts of
    one id stay or go together, and they stay if one of them is its group's first. Rows with a null id stay only if
    no row of their group has an id, all of them then.
    """
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    docs = docs.select(*COLUMNS)
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    groups = materialize(shingle_dedup.near_duplicates(docs))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    nameless = groups.where("doc_id is null and component_id is null").select("t").distinct()
    gone = materialize(groups.where("doc_id is not null").select("doc_id").distinct().join(first, "doc_id", "left_anti"))  # fewer than those that stay
    stays = docs.where("doc_id is not null").join(broadcast_if_small(gone), "doc_id", "left_anti")
    return stays.unionByName(docs.where("doc_id is null").join(nameless, F.xxhash64("text") == F.col("t"), "left_semi"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier are cut out; documents of which nothing is left go.

    Null and empty texts stay as they are. Earlier is a smaller id (a null one is the largest; texts of one id go by
    their hash), or an earlier start. Equal rows count as one.
    """
    kept = suffix_dedup.remove_repeats(docs, with_text=True, keep=["lang", "source"])
    kept = kept.where("n_removed = 0 or length(kept) > 0")
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, each row by its own text; null and empty texts and repeated rows stay."""
    texts = decontaminate.keyed(docs.select(*COLUMNS))
    hit = decontaminate.hits(texts, read_table(spark, sf_dir, "benchmark"))
    return texts.join(broadcast_if_small(hit.select(*decontaminate.KEY)), decontaminate.KEY, "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, by its source's target; ``mixing.mix`` says what ties, nulls and repeated rows come to."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark_passages", benchmark_passages), ("mixture", mixture)]

#: Trained scores, hashes and prefix names have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), scratch=False)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
