"""Deciding, deduplicating, naming and keeping track of documents.

Missing values are empty strings. seq is unique; of equal contents the least seq is kept. Rows without a key (null) are
duplicates of none. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import fold, normalize, strip
from folio.operators import naming


def content_key(text: Column) -> Column:
    """Hash of a document's text without white space at its ends; texts of under 200 characters, and null, have none."""
    return F.when(F.length(strip(text)) >= 200, F.sha2(strip(text), 256)).otherwise(F.lit(""))


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Column duplicate: an earlier file (by seq) has the same text, or the same bytes where there is too little text; a file without any hash is none."""
    key = F.coalesce(F.nullif(F.col("text_hash"), F.lit("")), F.col("file_hash"), F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    keyed = files.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("seq").alias("kept"))
    return keyed.join(first, "key").withColumn("duplicate", F.col("seq") > F.col("kept")).drop("key")


def bucket(multi: Column, name: Column, votes: Column, crossed: Column) -> Column:
    return F.when(multi, "review").when(name == "", "unreadable").when((votes < 2) & ~crossed, "review").otherwise("archive")


def route(official: Column, duplicate: Column, multi: Column, splittable: Column, name: Column, votes: Column, strict: bool = True) -> Column:
    """First rule that holds: unrelated, manual split or split, skipped, unreadable, verify, archive."""
    weak = (votes < 2) if strict else F.lit(False)
    return F.when(~official, "unrelated").when(multi & splittable, "split").when(multi, "manual split").when(duplicate, "skipped").when(name == "", "unreadable").when(weak, "verify").otherwise("archive")


def allocate_names(slugs: DataFrame) -> DataFrame:
    """Free names in order of seq: slug, slug_2, slug_3 ..; rows with used = true are taken as they are.

    A slug may itself end in a number; ``naming`` says how names interact and what is folded.
    """
    step = F.when(F.col("used"), naming.USED).otherwise(naming.REQUEST)
    seq = F.when(F.col("used"), F.lit(-1)).otherwise(F.col("seq")).cast("long")  # used names come before all requests
    given = naming.give_names(slugs.select(seq.alias("seq"), step.alias("step"), F.col("slug").alias("name")))
    taken = slugs.where("used").select(F.col("seq").cast("long").alias("seq"), "slug", "used", F.col("slug").alias("name"))
    return taken.unionByName(given.select("seq", "slug", F.lit(False).alias("used"), "name"))


def suggest_person(names: DataFrame, index: DataFrame, most: int = 2) -> DataFrame:
    """(name, key, distance, ambiguous): the index key nearest to a name, within ``most`` edits of its folded letters.

    Names of under five letters have no suggestion; of several nearest keys the first in
    order is given and marked ambiguous. Edits leave one of ``most`` + 1 parts of the name whole and at most
    ``most`` places off, so a key is only compared with names that hold one of its strings at a part's place.
    """
    a = names.select("name", fold(normalize(F.col("name"))).alias("f")).where(F.length("f") >= 5).distinct()
    b = index.select("key", fold(F.translate("key", "_", "")).alias("g")).where("g <> ''").distinct()

    def starts(length):
        return [F.floor(length * k / (most + 1)).cast("int") for k in range(most + 2)]

    own = starts(F.length("f"))
    parts = F.array(*(F.struct(F.length("f").alias("n"), F.lit(k).alias("k"), F.substring("f", own[k] + 1, own[k + 1] - own[k]).alias("part")) for k in range(most + 1)))
    left = a.withColumn("x", F.explode(parts))

    def near(n):
        cut = starts(n)
        return F.array(*(F.when(cut[k] + shift >= 0, F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(F.col("g"), cut[k] + shift + 1, cut[k + 1] - cut[k]).alias("part"))) for k in range(most + 1) for shift in range(-most, most + 1)))

    lengths = F.sequence(F.greatest(F.length("g") - most, F.lit(5)), F.greatest(F.length("g") + most, F.lit(5)))
    right = b.select("key", "g", F.explode(F.array_distinct(F.flatten(F.transform(lengths, near)))).alias("x")).where("x is not null")
    near_pairs = left.join(right, "x").select("name", "f", "key", "g").distinct().withColumn("distance", F.levenshtein("f", "g", most)).where("distance >= 0")
    best = near_pairs.withColumn("least", F.min("distance").over(Window.partitionBy("name"))).where("distance = least")
    return best.groupBy("name").agg(F.min("key").alias("key"), F.min("distance").alias("distance"), (F.count("*") > 1).alias("ambiguous"))


def update_lineage(processed: DataFrame, moves: DataFrame) -> DataFrame:
    """New targets for processed rows named by old target or source; moves that match none get a row of their own."""
    by_target = moves.select(F.col("old").alias("_t"), F.col("new").alias("_n1"))
    by_source = moves.select(F.col("old").alias("_s"), F.col("new").alias("_n2"))
    updated = processed.join(by_target, F.col("target") == F.col("_t"), "left").join(by_source, F.col("source") == F.col("_s"), "left")
    known = processed.select(F.col("target").alias("old")).union(processed.select("source")).distinct()
    added = moves.join(known, "old", "left_anti").select(F.concat(F.lit("target:"), F.col("old")).alias("hash"), F.col("old").alias("source"), F.col("new").alias("target"))
    return updated.select("hash", "source", F.coalesce("_n1", "_n2", "target").alias("target")).unionByName(added)


def upsert(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-empty cells of ``new`` overwrite those of ``base``."""
    renamed = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(renamed, key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))

