"""Plans and state of the archive as tables: actions, names, verification, lookup.

Missing values are empty strings. seq orders a run's documents and is unique in it. State is
three tables: processed(hash, source, target), pending(file, suggestion, national_id, registry_no, source) and
person_index(key, name, national_id, registry_no). Nothing is written before ``write_state`` is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import person_key, slug, strip
from folio.operators import naming
from folio.operators.registry import allocate_names
from folio.sources.scratch import cut

# The order in which folders are searched for a file.
FOLDERS = ("archive", "unreadable", "manual split", "verify", "error", "unrelated", "split/original", "split")


def multi_reason(suggestion: Column, distance: Column, ambiguous: Column) -> Column:
    """Why a document of several people without an id isn't split; a suggestion is never taken by itself."""
    text = F.when(ambiguous, F.format_string("no id; several people are near the name, the nearest is %s: decide by hand", suggestion))
    text = text.when(suggestion.isNotNull(), F.format_string("no id; the name suggests %s (distance %d): confirm by hand", suggestion, distance))
    return text.otherwise("several people, and no id of the first")


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def plan_actions(docs: DataFrame, processed: DataFrame, used: DataFrame, strict: bool = False) -> DataFrame:
    """The action for each document: doc_id, seq, source, kind, target, record, note and warnings.

    docs has doc_id, seq, source, file_hash, text_hash, name, national_id, registry_no,
    agreement, official, multi, splittable, reason, error and warnings. Errors, unrelated
    documents and those of several people are never taken as duplicates, but count as seen; another document
    is skipped if one of its hashes is among the processed ones or in an earlier row. Without a name for a file it is
    unreadable and keeps its own; with ``strict`` it goes to verification below two agreeing
    pages; else to the archive. used has the names already given, in archive and verification alike.
    """
    c = F.col
    kind = F.when(F.coalesce("error", F.lit("")) != "", "error").when(~c("official"), "unrelated").when(c("multi") & (c("national_id") != "") & c("splittable"), "split").when(c("multi"), "manual split").otherwise("plan")
    rows = docs.withColumn("kind", kind).withColumn("_key", F.coalesce(F.nullif("text_hash", F.lit("")), F.nullif("file_hash", F.lit("")), F.concat(F.lit("row:"), F.col("seq").cast("string"))))
    known = processed.groupBy("hash").agg(F.min("target").alias("t"))
    rows = rows.join(known.select(c("hash").alias("file_hash"), c("t").alias("_t1")), "file_hash", "left").join(known.select(c("hash").alias("text_hash"), c("t").alias("_t2")), "text_hash", "left")
    rows = rows.withColumn("_before", F.coalesce("_t1", "_t2"))
    marks = (c("kind") != "plan") | c("_before").isNull()  # what is known already is skipped and marks nothing
    rows = rows.join(rows.groupBy("_key").agg(F.min(F.when(marks, c("seq"))).alias("_first")), "_key")
    rows = rows.withColumn("_slug", slug(strip(c("name"))))
    planned = F.when(c("_before").isNotNull() | (c("seq") > c("_first")), "skipped").when(c("_slug") == "", "unreadable").when(F.lit(strict) & (c("agreement") < 2), "verify").otherwise("archive")
    rows = cut(rows.withColumn("kind", F.when(c("kind") == "plan", planned).otherwise(c("kind"))))  # read for the names, the targets and the first ones
    new = rows.where("kind in ('archive', 'verify')").select("seq", c("_slug").alias("slug"), F.lit(False).alias("used"))
    given = allocate_names(new.unionByName(used.select(F.lit(-1).cast("long").alias("seq"), c("name").alias("slug"), F.lit(True).alias("used")))).where("not used").select("seq", c("name").alias("_file"))
    rows = cut(rows.join(given, "seq", "left"))
    file = F.coalesce(F.concat("_file", F.lit(".pdf")), c("source"))
    rows = rows.withColumn("_target", F.when(c("kind") != "skipped", file))
    firsts = rows.where("seq = _first").select(c("_key"), c("_target").alias("_earlier"))
    rows = rows.join(firsts, "_key", "left")
    folder = F.when(c("kind") == "split", "split/original").otherwise(c("kind"))
    note = F.when(c("kind") == "skipped", F.concat(F.lit("same content as "), F.coalesce("_before", "_earlier"))).when(c("kind") == "unreadable", "no name").when(c("kind") == "verify", "pages do not agree").when(c("kind") == "error", c("error")).when(c("kind") == "unrelated", "no official mark").when(c("kind").isin("split", "manual split"), c("reason")).otherwise("")
    record = F.when(c("kind").isin("archive", "verify"), F.struct(strip(c("name")).alias("name"), "national_id", "registry_no"))
    return rows.select("doc_id", "seq", "source", "kind", F.when(c("kind") != "skipped", F.concat_ws("/", folder, "_target")).alias("target"), record.alias("record"), note.alias("note"), "warnings")


def state_after(actions: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """What the actions add to processed, pending and person_index; skipped documents add nothing."""
    c = F.col
    done = actions.where("kind <> 'skipped'").withColumn("file", F.element_at(F.split("target", "/"), -1))
    hashes = docs.select("doc_id", F.explode(F.array_distinct(F.array("file_hash", "text_hash"))).alias("hash")).where("hash <> ''")
    return {
        "processed": done.join(hashes, "doc_id").select("hash", "source", c("file").alias("target")),
        "pending": done.where("kind = 'verify'").select("file", c("record.name").alias("suggestion"), "record.national_id", "record.registry_no", "source"),
        "person_index": done.where("kind = 'archive'").select(person_key(c("record.name")).alias("key"), "record.name", "record.national_id", "record.registry_no"),
    }


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    """Each table to a folder of its own below ``path``, which mustn't hold it yet; actions are cut by kind."""
    for name, df in tables.items():
        writer = df.write.partitionBy("kind") if name == "actions" else df.write
        writer.parquet(f"{path}/{name}")


def original_names(files: DataFrame, pending: DataFrame, processed: DataFrame) -> DataFrame:
    """(file, original): the name a queued file was scanned under, from pending, else from processed, else its own."""
    one = pending.where("source <> ''").groupBy("file").agg(F.min("source").alias("_p"))
    two = processed.where("source <> ''").groupBy(F.col("target").alias("file")).agg(F.min("source").alias("_h"))
    return files.select("file").distinct().join(one, "file", "left").join(two, "file", "left").select("file", F.coalesce("_p", "_h", "file").alias("original"))


def find_files(names: DataFrame, files: DataFrame, processed: DataFrame) -> DataFrame:
    """(name, folder, file): where a document of this original name is now, from files(folder, file).

    First the source folder, then the originals of split files, then the targets of processed rows of that source, folder
    by folder, and last the verification queue; null if nowhere.
    """
    own = F.when(F.col("folder") == "source", 0).when(F.col("folder") == "split/original", 1).when(F.col("folder") == "verify", 100)
    direct = names.join(files, F.col("name") == F.col("file")).withColumn("rank", own)
    at = F.array_position(F.array(*map(F.lit, FOLDERS)), F.col("folder"))
    moved = names.join(processed.select(F.col("source").alias("name"), F.col("target").alias("file")).distinct(), "name").join(files, "file").withColumn("rank", F.when(at > 0, at + 1).cast("int"))
    found = direct.select("name", "folder", "file", "rank").unionByName(moved.select("name", "folder", "file", "rank")).where("rank is not null")
    best = found.groupBy("name").agg(F.min(F.struct("rank", "file", "folder")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", "b.folder", "b.file")


def verify_merge(checked: DataFrame, pending: DataFrame, processed: DataFrame, queue: DataFrame, used: DataFrame, fields: DataFrame) -> DataFrame:
    """What a person's check of the queue changes: seq, file, original, kind, target and record.

    checked has seq, file and true_name. A name gives an archived file under a new name (its own one is free for it) with the
    ids of fields(file, national_id, registry_no); an empty one makes it unreadable under its original name. A file that isn't
    in the queue, and a name without a letter for a file name, are skipped. Empty files come after all named ones, as their names
    only then become free.
    """
    c = F.col
    rows = checked.join(queue.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left").join(original_names(checked, pending, processed), "file")
    rows = rows.withColumn("name", strip(F.coalesce("true_name", F.lit("")))).withColumn("_slug", slug(c("name")))
    kind = F.when(c("_there").isNull(), "not in the queue").when(c("name") == "", "unreadable").when(c("_slug") == "", "no file name").otherwise("archive")
    rows = cut(rows.withColumn("kind", kind))
    event = lambda df, seq, step, name: df.select(seq.cast("long").alias("seq"), F.lit(step).alias("step"), name.alias("name"))
    named = rows.where("kind = 'archive'")
    events = event(named, c("seq"), naming.RELEASE, stem(c("file"))).unionByName(event(named, c("seq"), naming.REQUEST, c("_slug"))).unionByName(event(used, F.lit(-1), naming.USED, c("name")))
    given = naming.give_names(events).select("seq", c("name").alias("given"))
    ids = fields.select("file", "national_id", "registry_no")
    rows = rows.join(given, "seq", "left").join(ids, "file", "left")
    target = F.when(c("kind") == "archive", F.concat("given", F.lit(".pdf"))).when(c("kind") == "unreadable", c("original"))
    record = F.when(c("kind") == "archive", F.struct("name", F.coalesce("national_id", F.lit("")).alias("national_id"), F.coalesce("registry_no", F.lit("")).alias("registry_no")))
    return rows.select("seq", "file", "original", "kind", target.alias("target"), record.alias("record"))
