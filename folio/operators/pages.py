"""Pages of documents: statistics, blank pages, ownership, blocks, split plans, page editing.

Page numbers are unique in a document. Null texts count as empty, a null owner is no owner, and rows with a null
doc_id form a document of their own; a document without pages has no rows, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import normalize, strip
from folio.operators.votes import same_person

# Characters of a text page, of a blank page, of an attachment, and the limits of a white page.
TEXT_CHARS, BLANK_CHARS, ATTACHMENT_CHARS = 100, 20, 40
LETTERS = "ABCDEFGH"
# Fixed value: what stands before a name that is a page's owner for want of an id.
BY_NAME = "isim:"


def n_chars(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit(""))))


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages, text pages and median characters of each document; has_text if the median is a text page's."""
    n = n_chars(F.col("page_text"))
    median = F.expr("percentile(n, 0.5)")
    return pages.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n") >= TEXT_CHARS).alias("n_text_pages"), median.alias("median_chars"), (median >= TEXT_CHARS).alias("has_text"))


def is_blank(text: Column, white: Column, std: Column) -> Column:
    return (n_chars(text) <= BLANK_CHARS) & ((white >= 0.98) | ((white >= 0.90) & (std <= 5)))


def page_kind(text: Column, owned: Column) -> Column:
    return F.when(owned, F.lit("owned")).when(n_chars(text) <= ATTACHMENT_CHARS, F.lit("attachment")).otherwise(F.lit("suspicious"))


def fill_owners(pages: DataFrame, attachments_only: bool = True) -> DataFrame:
    """Pages without an owner take the one before, leading ones the next; only attachments, or all."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    before = F.last("owner", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("owner", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    filled = F.coalesce(before, after)
    return pages.withColumn("filled", F.when(F.col("owner").isNotNull() | (F.col("page_kind") == "attachment"), filled) if attachments_only else filled)


def blocks(pages: DataFrame, label: str = "who") -> DataFrame:
    """(doc_id, who, first_page, last_page) of consecutive pages with one label."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    runs = pages.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("doc_id", "_run", F.col(label).alias("who")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("_run")


def owner_letters(pages: DataFrame, primary: Column | None = None) -> DataFrame:
    """Letters by first appearance, up to H; more, and pages without owner, ?.

    A is the primary owner's (a Column; null or empty if there is none), wherever it first appears, and else the first owner's.
    """
    chosen = F.coalesce(primary, F.lit("")) if primary is not None else F.lit("")
    first = pages.withColumn("_p", chosen).where("owner is not null").groupBy("doc_id", "owner", "_p").agg(F.min("page_no").alias("first")).withColumn("_own", F.col("owner") == F.col("_p"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "_own").orderBy("first"))
    place = F.when(F.col("_own"), 1).otherwise(rank + (F.col("_p") != "").cast("int"))
    letters = first.withColumn("rank", place).select("doc_id", "owner", F.when(F.col("rank") <= len(LETTERS), F.substring(F.lit(LETTERS), F.col("rank"), F.lit(1))).otherwise(F.lit("?")).alias("letter"))
    return pages.join(letters, ["doc_id", "owner"], "left").withColumn("letter", F.coalesce("letter", F.lit("?")))


def name_owners(pages: DataFrame, primary: str | Column, primary_name: str | Column, tasks: int | None = None) -> DataFrame:
    """Owners by name where ids give none: pages have owner, page_kind and name (normalised; null and empty ones count for nothing).

    Attachments take their owners first. Of the pages still without one that have a name and aren't suspicious, those named like
    the primary person are that person's; the first other name is the second person, and pages named like
    it get this name as owner. Names are alike by ``votes.same_person``. A document without a primary name stays as it is.
    Pages are dealt by document anew after each comparison of names, to ``tasks`` partitions if given.
    """
    dealt = lambda rows: rows.repartition(tasks, "doc_id") if tasks else rows
    who, name = (F.lit(x) if isinstance(x, str) else x for x in (primary, primary_name))
    whole = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = fill_owners(pages.withColumn("_who", who).withColumn("_first", normalize(F.coalesce(name, F.lit("")))))
    open_ = F.col("filled").isNull() & (F.col("page_kind") != "suspicious") & (F.col("name") != "") & (F.col("_first") != "")
    rows = rows.withColumn("_open", F.when(open_, F.col("name")))
    rows = rows.withColumn("_is_first", same_person("_open", F.when(F.col("_open").isNotNull(), F.col("_first"))))
    rows = dealt(rows).withColumn("_second", F.first(F.when(~F.col("_is_first"), F.col("_open")), True).over(whole))
    second = F.when(F.col("_is_first"), F.lit(False)).otherwise(same_person(F.when(~F.col("_is_first"), F.col("_open")), "_second"))
    owner = F.coalesce("filled", F.when(F.col("_is_first"), F.col("_who")).when(second, F.concat(F.lit(BY_NAME), "_second")))
    return dealt(rows.withColumn("owner", owner).drop("filled", "_who", "_first", "_open", "_is_first", "_second"))


def split_plan(pages: DataFrame, primary: str | Column = "A", primary_name: str | Column | None = None, tasks: int | None = None) -> DataFrame:
    """map, second, n_blocks, splittable and reason of each document from pages with owner and page_kind.

    The map is the one after attachments have taken their owners. A suspicious page stops
    the split, and so does the lack of a second person; else it takes exactly
    two blocks, one of the primary person and one of the second (the first other in page order).
    With a primary name, and a column name, names are a second signal (``name_owners``); the second person may then be ``isim:`` and a name.
    """
    who = F.lit(primary) if isinstance(primary, str) else primary
    named = primary_name is not None
    pages = name_owners(pages, who, primary_name, tasks) if named else pages
    w = Window.partitionBy("doc_id").orderBy("page_no")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.coalesce(F.last("owner", True).over(back), F.first("owner", True).over(ahead))
    rows = pages.withColumn("_primary", who).withColumn("_near", near)
    takes = F.lit(False) if named else F.col("page_kind") == "attachment"  # by names, attachments have taken theirs already
    rows = rows.withColumn("_own", F.when(F.col("owner").isNotNull() | takes, F.col("_near")))
    other = lambda c: F.when(F.col(c) != F.col("_primary"), F.col(c))
    rows = rows.withColumn("_second", F.first(other("_own"), True).over(whole))
    rows = rows.withColumn("_who", F.when(F.col("_near") == F.col("_primary"), "A").when(F.col("_near") == F.col("_second"), "B").otherwise("?"))
    rows = rows.withColumn("_new", F.coalesce(F.col("_who") != F.lag("_who").over(w), F.lit(True)))
    letter = F.when(F.col("_own").isNull(), "?").when(F.col("_own") == F.col("_primary"), "A").otherwise("B")
    plan = rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", letter.alias("w")))), lambda x: x["w"]), "").alias("map"),
        F.first("_second").alias("second"),
        F.count_if("_new").alias("n_blocks"),
        F.count_if(F.col("_new") & (F.col("_who") == "?")).alias("_others"),
        F.count_if(F.col("page_kind") == "suspicious").alias("_suspicious"),
    )
    reason = F.when(F.col("_suspicious") > 0, "suspicious page").when(F.col("second").isNull(), "no second person").when(F.col("n_blocks") != 2, "interleaved").when(F.col("_others") > 0, "third person").otherwise("")
    return plan.select("doc_id", "map", "second", "n_blocks", (reason == "").alias("splittable"), reason.alias("reason"))


def document_analysis(fields: DataFrame, multi: DataFrame, pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, name, national_id, registry_no, multi, primary, and the split plan's map, second, splittable and reason.

    fields is what extraction or reconciliation gives, multi has doc_id and multi, pages what ``split_plan`` reads. Only documents of several
    people with an id or a name are planned: by their id, or else by ``isim:`` and the normalised name; the others' plan is null. Moves no file.
    """
    by_name = F.when(F.col("name") != "", F.concat(F.lit(BY_NAME), normalize(F.col("name"))))
    several = F.coalesce("multi", F.lit(False))
    rows = fields.select("doc_id", "name", "national_id", "registry_no").join(multi.select("doc_id", "multi"), "doc_id", "left").withColumn("multi", several)
    rows = rows.withColumn("primary", F.when(F.col("multi"), F.coalesce(F.nullif("national_id", F.lit("")), by_name)))
    wanted = rows.where("primary is not null").select("doc_id", "primary", F.col("name").alias("_primary_name"))
    plan = split_plan(pages.select("doc_id", "page_no", "owner", "page_kind", "name").join(wanted, "doc_id"), F.col("primary"), F.col("_primary_name"), tasks)
    return rows.join(plan.select("doc_id", "map", "second", "splittable", "reason"), "doc_id", "left")


def plan_json(pages: DataFrame, plan: DataFrame, primary: Column) -> DataFrame:
    """(doc_id, plan): a split plan as JSON, with each page's number, owner letter, suggestion and id.

    Pages have owner and page_kind. A page's letter goes by its id, so a third person shows as C, where the map says B.
    """
    owned = fill_owners(pages).drop("owner").withColumnRenamed("filled", "owner")
    lettered = owner_letters(owned, primary).join(plan.select("doc_id", "map", "second"), "doc_id").withColumn("suggestion", F.substring("map", F.col("page_no").cast("int"), F.lit(1)))
    person = F.coalesce("owner", F.when(F.col("suggestion") == "A", primary).when(F.col("suggestion") == "B", F.col("second")), F.lit(""))
    page = F.struct(F.col("page_no").alias("no"), F.col("letter").alias("owner"), "suggestion", person.alias("id"))
    listed = lettered.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return plan.join(listed, "doc_id").select("doc_id", F.to_json(F.struct("map", F.coalesce("second", F.lit("")).alias("second"), "splittable", "reason", "pages")).alias("plan"))


def spread_suggestion(pages: DataFrame) -> DataFrame:
    """Column spread: open pages (?) take the letter before, A at the start; a page's own letter counts where any differs from the map."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    differs = F.max(F.coalesce(F.col("letter") != F.col("suggestion"), F.lit(False))).over(Window.partitionBy("doc_id"))
    rows = pages.withColumn("_l", F.when(differs, F.coalesce("letter", "suggestion")).otherwise(F.col("suggestion")))
    return rows.withColumn("spread", F.coalesce(F.last(F.nullif("_l", F.lit("?")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("A"))).drop("_l")


def user_plan(maps: DataFrame) -> DataFrame:
    """A person's own map: splittable unless a page is open (?) or all pages are X; letters A-H, X and ? only."""
    reason = F.when(~F.col("map").rlike("^[A-HX?]+$"), "bad map").when(F.col("map").contains("?"), "open page").when(F.col("map").rlike("^X+$"), "no pages").otherwise("")
    return maps.withColumn("splittable", reason == "").withColumn("reason", reason)


def map_groups(maps: DataFrame) -> DataFrame:
    """(doc_id, letter, page_no, new_no): the pages of each letter, renumbered."""
    pages = maps.select("doc_id", F.posexplode(F.split("map", "")).alias("pos", "letter"))
    return pages.select("doc_id", "letter", (F.col("pos") + 1).alias("page_no"), F.row_number().over(Window.partitionBy("doc_id", "letter").orderBy("pos")).alias("new_no"))


def split_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Pages of each block as a document of its own, named by its range and owner."""
    joined = pages.join(parts, "doc_id").where(F.col("page_no").between(F.col("first_page"), F.col("last_page")))
    name = F.concat_ws("_", F.col("doc_id"), F.concat(F.lit("part"), F.col("first_page"), F.lit("-"), F.col("last_page")), F.col("who"))
    return joined.withColumn("part_id", name).withColumn("new_no", F.col("page_no") - F.col("first_page") + 1)


def merge_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """A new document from (doc_id, page_no, position), repeats kept."""
    joined = order.join(pages, ["doc_id", "page_no"])
    return joined.withColumn("new_no", F.row_number().over(Window.partitionBy("target").orderBy("position")))


def remove_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages that aren't in (doc_id, page_no), renumbered."""
    return pages.join(gone, ["doc_id", "page_no"], "left_anti").withColumn("new_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
