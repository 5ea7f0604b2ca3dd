"""Review of queued documents as changes of tables: buckets, corrections, page moves, reports.

documents has doc_id, file, state (queued, done, error), bucket, why, name, national_id,
registry_no, agreement, multi, n_pages, note, error and version; assignment has doc_id,
page_no and letter. A change returns the whole table anew; version goes up by one where pages changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import normalize, strip, undot
from folio.sources import numbered

BUCKETS = ("archive", "review", "unreadable", "error", "queued", "split")


def bucket_counts(documents: DataFrame) -> DataFrame:
    """(bucket, n) of all buckets, queued ones by state and the others by bucket; a bucket of another name counts under its own."""
    place = F.when(F.col("state") == "queued", "queued").otherwise(F.col("bucket"))
    every = documents.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    found = documents.select(place.alias("bucket")).where("bucket <> ''").groupBy("bucket").agg(F.count("*").alias("n"))
    return found.join(every, "bucket", "full").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def percent(done: Column, total: Column) -> Column:
    """Whole per cents, cut off; 0 of nothing."""
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(0).cast("int")


def seconds_left(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))


def job_candidates(documents: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Documents to work on: those chosen (doc_id), or all that are queued or in error."""
    if chosen is not None:
        return documents.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    return documents.where(F.col("state").isin("queued", "error"))


def archive_candidates(documents: DataFrame, single_person: bool = False) -> DataFrame:
    """Done documents for the archive or unreadable ones, with column problem where one may hold several people."""
    rows = documents.where((F.col("state") == "done") & F.col("bucket").isin("archive", "unreadable"))
    return rows.withColumn("problem", F.when(F.col("multi") & F.lit(not single_person), "several people: assign the pages first").otherwise(""))


def approved(documents: DataFrame) -> DataFrame:
    """Documents as a person's approval hands them to the plan: agreement is two at least, and an unreadable one has no name."""
    nameless = (F.col("bucket") == "unreadable") | ((F.col("why") == "unreadable") & (strip(F.col("name")) == ""))
    return documents.withColumn("agreement", F.when(nameless, 0).otherwise(F.greatest("agreement", F.lit(2)))).withColumn("name", F.when(nameless, "").otherwise(F.col("name")))


def assign_pages(documents: DataFrame, maps: DataFrame) -> DataFrame:
    """Documents with new page maps (doc_id, map) of A-H, X and ?, a letter a page; problem says what is wrong with a map, which then changes nothing.

    Pages of several people, or of another document (X), make a document one of several people.
    """
    rows = documents.join(maps, "doc_id", "left")
    m = F.col("map")
    problem = F.when(m.isNull(), "").when(F.length(m) != F.col("n_pages"), "pages missing").when(~m.rlike("^[A-HX?]+$"), "bad letter").otherwise("")
    letters = F.array_except(F.array_distinct(F.split(m, "")), F.array(F.lit("?"), F.lit("X")))
    several = (problem == "") & (m.contains("X") | (F.size(letters) > 1))
    several = F.coalesce(several, F.lit(False))
    return rows.withColumn("problem", problem).withColumn("multi", F.col("multi") | several).withColumn("why", F.when(several, "several people").otherwise(F.col("why"))).drop("map")


def correct_fields(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Names, ids and registry numbers as a person gives them (doc_id, name, national_id, registry_no; null leaves a number as it is); a name takes a document from unreadable to review."""
    new = changes.select("doc_id", strip(F.coalesce("name", F.lit(""))).alias("_n"), strip(F.col("national_id")).alias("_i"), strip(F.col("registry_no")).alias("_r"))
    rows = documents.join(new, "doc_id", "left")
    saved = F.col("_n").isNotNull() & (F.col("_n") != "") & (F.col("bucket") == "unreadable")
    rows = rows.withColumn("name", F.coalesce("_n", "name")).withColumn("national_id", F.coalesce("_i", "national_id")).withColumn("registry_no", F.coalesce("_r", "registry_no"))
    return rows.withColumn("why", F.when(saved, "to verify").otherwise(F.col("why"))).withColumn("bucket", F.when(saved, "review").otherwise(F.col("bucket"))).drop("_n", "_i", "_r")


def skip(documents: DataFrame, skipped: DataFrame) -> DataFrame:
    """Skipped documents (doc_id) become unreadable."""
    rows = documents.join(skipped.select("doc_id").distinct().withColumn("_s", F.lit(True)), "doc_id", "left")
    value = lambda new, c: F.when(F.col("_s"), new).otherwise(F.col(c))
    return rows.withColumn("bucket", value("unreadable", "bucket")).withColumn("why", value("unreadable", "why")).withColumn("note", value("skipped by hand", "note")).drop("_s")


def mark_exactly(rows: DataFrame, key: str, marked: DataFrame, column: str, value: str) -> DataFrame:
    """Column set to ``value`` in the rows whose key is in marked, and to the empty string in all others."""
    found = marked.select(key).distinct().withColumn("_m", F.lit(True))
    return rows.drop(column).join(found, key, "left").withColumn(column, F.when(F.col("_m"), value).otherwise("")).drop("_m")


def split_approved(documents: DataFrame, assignment: DataFrame) -> DataFrame:
    """New queued documents from fully assigned ones: part_id, doc_id, letter, page_no and new_no of each page; a document with an open page, or of X alone, has no parts."""
    open_or_none = assignment.groupBy("doc_id").agg(F.max(F.col("letter") == "?").alias("_o"), F.min(F.col("letter") == "X").alias("_x"), F.count("*").alias("_n"))
    good = documents.join(open_or_none, "doc_id").where("not _o and not _x and _n = n_pages").select("doc_id", "file")
    pages = assignment.join(good, "doc_id")
    part = F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("_"), F.col("letter"))
    return pages.select(part.alias("part_id"), "doc_id", "letter", "page_no", F.row_number().over(Window.partitionBy("doc_id", "letter").orderBy("page_no")).alias("new_no"))


def move_pages(assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """Assignment after pages moved (doc_id, page_no, target, position): a moved page comes before the target's page at that position, or last if it is null or too high.

    Several pages for one position keep the order of doc_id and page_no. A document that would lose all its pages keeps them, and so
    does one whose page would go to itself.
    """
    left = assignment.join(moves.where("doc_id <> target"), ["doc_id", "page_no"], "left_anti").groupBy("doc_id").agg(F.lit(True).alias("_keeps")).distinct()
    legal = moves.where("doc_id <> target").join(left, "doc_id", "left_semi")
    sizes = assignment.groupBy(F.col("doc_id").alias("target")).agg(F.max("page_no").alias("_size"))
    legal = legal.join(sizes, "target")
    at = F.when(F.col("position").between(1, F.col("_size")), F.col("position") * 2 - 1).otherwise(F.col("_size") * 2 + 1)
    marked = assignment.join(legal.select("doc_id", "page_no", "target", at.alias("_at")), ["doc_id", "page_no"], "left")
    placed = marked.select(F.coalesce("target", "doc_id").alias("doc_id"), F.coalesce("_at", F.col("page_no") * 2).alias("_at"), F.col("doc_id").alias("from_doc"), F.col("page_no").alias("from_page"), "letter")
    order = Window.partitionBy("doc_id").orderBy("_at", "from_doc", "from_page")
    return placed.withColumn("page_no", F.row_number().over(order)).drop("_at")


def merge_documents(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """doc_id, file, n_pages, pages and problem of each new document from steps (target, position, doc_id, page_no).

    documents has doc_id, file and n_pages. Pages come in order of position, repeats kept, as structs (new_no, doc_id, page_no). The new file's name is its sources' names in order of first use with plus signs between, or
    ``birlesik_N_belge.pdf`` beyond 80 characters. A step without its document, or with a page that the document doesn't have, is a problem: that merge has no pages.
    """
    c = F.col
    rows = steps.join(documents.select("doc_id", "file", "n_pages"), "doc_id", "left")
    bad = c("file").isNull() | ~F.coalesce(c("page_no").between(1, c("n_pages")), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("position", "doc_id", "page_no", "file")))
    merged = rows.groupBy("target").agg(F.bool_or(bad).alias("_bad"), ordered.alias("_all"))
    names = F.transform(F.array_distinct(F.transform("_all", lambda x: F.struct(x["doc_id"], x["file"]))), lambda x: x["file"])
    joined = F.array_join(names, " + ")
    file = F.when(F.length(joined) > 80, F.concat(F.lit("birlesik_"), F.size(names).cast("string"), F.lit("_belge.pdf"))).when(F.lower(joined).endswith(".pdf"), joined).otherwise(F.concat(joined, F.lit(".pdf")))
    pages = F.transform("_all", lambda x, k: F.struct((k + 1).alias("new_no"), x["doc_id"].alias("doc_id"), x["page_no"].alias("page_no")))
    good = lambda x: F.when(~c("_bad"), x)
    return merged.select(c("target").alias("doc_id"), good(file).alias("file"), good(F.size("_all").cast("long")).alias("n_pages"), good(pages).alias("pages"), F.when(c("_bad"), "no such page").otherwise("").alias("problem"))


def after_merge(documents: DataFrame, merged: DataFrame) -> DataFrame:
    """documents with the merged ones queued, and their sources done, in bucket split with the new document's id as their reason (of several the least)."""
    good = merged.where("problem = ''")
    used = good.select(F.explode("pages").alias("p"), F.col("doc_id").alias("_into")).groupBy(F.col("p.doc_id").alias("doc_id")).agg(F.min("_into").alias("_into"))
    rows = documents.join(used, "doc_id", "left")
    value = lambda new, c: F.when(F.col("_into").isNotNull(), new).otherwise(F.col(c)).alias(c)
    changed = {"state": F.lit("done"), "bucket": F.lit("split"), "why": F.concat(F.lit("merged into "), F.col("_into").cast("string"))}
    kept = rows.select(*(value(changed[c], c) if c in changed else F.col(c) for c in documents.columns))
    new = good.select("doc_id", "file", "n_pages", F.lit("queued").alias("state"), F.lit("").alias("bucket"), F.lit("").alias("why"), F.lit(1).alias("version"))
    return kept.unionByName(new.select(*(F.col(c).cast(t).alias(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in documents.dtypes)))


def detach_pages(assignment: DataFrame, gone: DataFrame) -> DataFrame:
    """Assignment after pages left for a new document (doc_id, page_no, new_doc); a document keeps its pages if all would go."""
    keeps = assignment.join(gone, ["doc_id", "page_no"], "left_anti").select("doc_id").distinct()
    marked = assignment.join(gone.join(keeps, "doc_id", "left_semi"), ["doc_id", "page_no"], "left")
    to = F.coalesce("new_doc", "doc_id")
    letter = F.when(F.col("new_doc").isNotNull(), "?").otherwise(F.col("letter"))
    return marked.select(to.alias("doc_id"), F.row_number().over(Window.partitionBy(to).orderBy("doc_id", "page_no")).alias("page_no"), F.col("doc_id").alias("from_doc"), F.col("page_no").alias("from_page"), letter.alias("letter"))


def touch(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents whose pages changed are queued again, without bucket, as the next version."""
    rows = documents.join(changed.select("doc_id").distinct().withColumn("_c", F.lit(True)), "doc_id", "left")
    value = lambda new, c: F.when(F.col("_c"), new).otherwise(F.col(c))
    return rows.withColumn("state", value("queued", "state")).withColumn("bucket", value("", "bucket")).withColumn("version", value(F.col("version") + 1, "version")).drop("_c")


def decision(assignment: DataFrame, multi: Column) -> DataFrame:
    """(doc_id, n_open, waits, splits): a document for splitting waits while a page is open; multi is a column of assignment."""
    people = F.count_distinct(F.when(~F.col("letter").isin("?", "X"), F.col("letter")))
    found = assignment.groupBy("doc_id").agg(F.count_if(F.col("letter") == "?").alias("n_open"), (F.bool_or(multi) | (people > 1) | F.bool_or(F.col("letter") == "X")).alias("_c"))
    return found.select("doc_id", "n_open", (F.col("_c") & (F.col("n_open") > 0)).alias("waits"), (F.col("_c") & (F.col("n_open") == 0)).alias("splits"))


def next_in_review(documents: DataFrame, group: str | None = None) -> DataFrame:
    """(doc_id, next): the document after each one in review, in order of seq, the first after the last; null if it is alone. ``group`` makes queues of their own."""
    queue = documents.where("bucket = 'review'")
    keys = [group] if group else []
    w = Window.partitionBy(*keys).orderBy("seq")
    ends = queue.groupBy(*keys).agg(F.min_by("doc_id", "seq").alias("_f"))
    rows = queue.withColumn("_n", F.lead("doc_id").over(w))
    rows = rows.join(ends, keys) if keys else rows.join(F.broadcast(ends))  # one row
    following = F.coalesce("_n", "_f")
    return rows.select("doc_id", F.when(following != F.col("doc_id"), following).alias("next"))


def signature(documents: DataFrame) -> DataFrame:
    """(doc_id, signature): a hash that changes with what a viewer shows of a document."""
    return documents.select("doc_id", F.xxhash64("state", "bucket", "why", "version", "name", "national_id", "registry_no", "agreement", "error").alias("signature"))


def action_lines(actions: DataFrame) -> DataFrame:
    """(doc_id, line) of a report: source, kind, the new name where there is one, how far pages agree, and the note."""
    target = F.when(F.col("kind").isin("archive", "verify"), F.element_at(F.split("target", "/"), -1)).otherwise("")
    trust = F.when(F.col("agreement") >= 2, F.format_string("[%d pages agree]", F.col("agreement"))).when(F.col("kind") == "archive", "[no agreement]").otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("("), F.col("note"), F.lit(")"))).otherwise("")
    return actions.select("doc_id", F.array_join(F.filter(F.array("source", "kind", target, trust, note), lambda x: x != ""), " ").alias("line"))


def suggestion_text(file: Column, suggestion: Column) -> Column:
    """The pending suggestion, or the file's own name in capitals."""
    return F.coalesce(F.nullif(suggestion, F.lit("")), F.upper(F.translate(F.regexp_replace(file, r"\.[^.]*$", ""), "_", " ")))


def error_class(truth: Column, found: Column) -> Column:
    """right, unread, dot only (the dotted i), or different, of names once normalized."""
    a, b = normalize(truth), normalize(found)
    return F.when(a == b, "right").when(b == "", "unread").when(undot(a) == undot(b), "dot only").otherwise("different")


def consensus_report(rows: DataFrame) -> DataFrame:
    """One row: agreed right, agreed wrong, no agreement and absent documents, from truth, agreed (null: document absent); precision and coverage."""
    right = F.col("agreed") == F.col("truth")
    n = lambda c, name: F.count_if(c).alias(name)
    made = rows.where("truth <> ''").agg(n(F.col("agreed").isNull(), "n_absent"), n((F.col("agreed") != "") & right, "n_right"), n((F.col("agreed") != "") & ~right, "n_wrong"), n(F.col("agreed") == "", "n_none"))
    given, measured = F.col("n_right") + F.col("n_wrong"), F.col("n_right") + F.col("n_wrong") + F.col("n_none")
    return made.withColumn("precision", F.round(F.try_divide("n_right", given), 6)).withColumn("coverage", F.round(F.try_divide(given, measured), 6))


def training_rows(rows: DataFrame, prompt: str) -> DataFrame:
    """(id, messages): a question and a name as a chat, for rows with a name."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", F.lit(None).cast("string")), part("text", F.lit(prompt))).alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.array(part("text", strip(F.col("name")))).alias("content"))
    return rows.where(strip(F.col("name")) != "").select("id", F.array(user, answer).alias("messages"))


def train_val(rows: DataFrame, id_col: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """Column part: val for a share of the rows (one at least, rounded half to even), the first in the order of a hash of id and seed, train for the rest."""
    n = max(1, round(rows.count() * share))
    drawn = numbered(rows.withColumn("_h", F.concat(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), F.col(id_col).cast("string"))), "_h")
    return drawn.withColumn("part", F.when(F.col("seq") <= n, "val").otherwise("train")).drop("_h", "seq")
