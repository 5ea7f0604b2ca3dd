"""From documents to planned actions; nothing is moved until apply_plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.pages import page_stats
from folio.operators.registry import content_key, mark_duplicates


def document_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, kind): duplicates are skipped, documents without a text layer unreadable, very long ones to be verified, the rest archived."""
    pages = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("page_text"))
    files = docs.select(F.col("doc_id").alias("seq"), "lang", content_key(F.col("text")).alias("text_hash"), F.sha2("text", 256).alias("file_hash"))
    marked = mark_duplicates(files).select(F.col("seq").alias("doc_id"), "lang", "duplicate")
    kind = F.when(F.col("duplicate"), "skipped").when(~F.col("has_text"), "unreadable").when(F.col("n_pages") > 12, "verify").otherwise("archive")
    return marked.join(page_stats(pages), "doc_id").select("doc_id", "lang", kind.alias("kind"))


def apply_plan(actions: DataFrame, path: str, dry_run: bool = True) -> int:
    """Write planned actions by kind; a dry run writes nothing, and what exists is never overwritten. Returns their number."""
    n = actions.where("kind <> 'skipped'").count()
    if not dry_run:
        actions.where("kind <> 'skipped'").write.mode("errorifexists").partitionBy("kind").parquet(path)
    return n
