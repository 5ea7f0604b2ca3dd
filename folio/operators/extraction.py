"""Fields of a document from its pages and words: extraction, page owners, gates, coverage.

pages has doc_id, page_no and page_text; words is described in ``layout``. Null page texts
count as empty; documents without pages have no rows; rows that repeat a page count as
two pages. Empty string stands for a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.registry_numbers import DN, LABEL, PROVINCE, candidates, decision
from folio.functions.text import id_valid, name_letters, normalize, only_digits, plausible_name, valid_ids
from folio.operators.layout import ID_LABEL, NAME_LABEL, ON_PAGE, SPARE_LABEL, labelled_boxes, labelled_values, line_box

OFFICIAL_PAGES = 5


def whole_text(pages: DataFrame, between: str = "") -> DataFrame:
    """(doc_id, text): a document's page texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), between).alias("text"))


def registry_boxes(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, box) of the first word, in page and word order, that holds a DN number."""
    box = F.struct("page_no", F.struct("x0", "y0", "x1", "y1").alias("box"))
    return words.where(F.col("word").rlike(DN)).groupBy("doc_id").agg(F.min_by(box, F.struct("page_no", "word_no")).alias("f")).select("doc_id", "f.page_no", "f.box")


def extract(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Name, id and registry number of each document, where they stand, and warnings.

    The first page with a DN number is looked at first, then all in order. The id comes from its label
    alone, with exactly eleven digits and a right checksum. The name comes from the first
    page whose label has a plausible one, and only if there is none from the spare label;
    without any, the earliest page with a label's value gives the box to read (the main
    label's on equal pages). name_page, name_box, id_page, id_box, registry_page and
    registry_box are null where nothing was found. warning is the registry number's; warnings has all.
    """
    first = pages.where(F.col("page_text").rlike(DN)).groupBy("doc_id").agg(F.min("page_no").alias("dn_page"))
    place = F.struct((~F.col("page_no").eqNullSafe(F.col("dn_page"))).alias("late"), F.col("page_no").alias("no"))
    found = labelled_values(words, (NAME_LABEL, SPARE_LABEL, ID_LABEL)).join(first, "doc_id", "left").withColumns({"rank": place, "spare": (F.col("label") == SPARE_LABEL).cast("int")})
    is_id = F.col("label") == ID_LABEL
    good, digits = plausible_name(F.col("value")), only_digits(F.col("value"))
    right, id_ = id_valid(F.col("id")), F.when(is_id & digits.rlike("^[1-9][0-9]{10}$"), digits)
    found = found.withColumn("id", id_).groupBy("doc_id").agg(
        F.min_by(F.struct(name_letters(F.col("value")).alias("name"), "page_no", "box"), F.when(~is_id & good, F.struct("spare", "rank"))).alias("n"),
        F.min_by(F.struct("page_no", "box"), F.when(~is_id & ~good, F.struct("page_no", "spare"))).alias("b"),
        F.max(F.when(~is_id, good)).alias("named"),
        F.min_by(F.struct("page_no", "box"), F.when(is_id, F.col("rank"))).alias("i"),
        F.min(F.when(is_id & right, F.struct("rank", "id"))).alias("v"),
        F.collect_list(F.when(is_id & ~right, F.col("rank"))).alias("bad"),
    )
    numbers = whole_text(pages, "\n").select("doc_id", decision(F.col("text")).alias("r"))
    boxes = registry_boxes(words).select("doc_id", F.col("page_no").alias("registry_page"), F.col("box").alias("registry_box"))
    out = numbers.join(found, "doc_id", "left").join(boxes, "doc_id", "left")
    named_at = F.when(F.col("named"), F.struct("n.page_no", "n.box")).otherwise(F.struct("b.page_no", "b.box"))
    failed = F.when(F.col("v").isNull(), F.size("bad")).otherwise(F.size(F.filter("bad", lambda x: x < F.col("v.rank"))))
    has_name, has_id = F.coalesce("named", F.lit(False)), F.col("v").isNotNull()
    no_name = F.when(~has_name & F.col("b").isNotNull(), "name unreadable, box kept").when(~has_name, "name not found")
    warnings = F.concat(
        F.filter(F.array(F.nullif("r.warning", F.lit(""))), lambda x: x.isNotNull()),
        F.array_repeat(F.lit("id checksum"), F.greatest(F.coalesce(failed, F.lit(0)), F.lit(0))),
        F.filter(F.array(F.when(~has_id, "id not found"), no_name), lambda x: x.isNotNull()),
    )
    return out.select(
        "doc_id",
        F.when(has_name, F.col("n.name")).otherwise("").alias("name"),
        named_at["page_no"].alias("name_page"),
        named_at["box"].alias("name_box"),
        F.coalesce("v.id", F.lit("")).alias("national_id"),
        F.col("i.page_no").alias("id_page"),
        F.col("i.box").alias("id_box"),
        F.col("r.value").alias("registry_no"),
        "registry_page",
        "registry_box",
        F.col("r.warning").alias("warning"),
        warnings.alias("warnings"),
    )


def crop_boxes(words: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, page_no, box): the line to cut out for a reader, from the name label or else the spare one; widths has page_width by page."""
    found = labelled_boxes(words, (NAME_LABEL, SPARE_LABEL))
    one = found.groupBy(*ON_PAGE).agg(F.min_by(F.struct("x0", "y0", "y1"), F.col("label") == SPARE_LABEL).alias("b")).join(widths, ON_PAGE)
    return one.select(*ON_PAGE, line_box(F.col("b.x0"), F.col("b.y0"), F.col("b.y1"), F.col("page_width")).alias("box"))


def page_owners(pages: DataFrame, words: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, id, name) of each page.

    The id is the labelled one if valid, else what a reader made of the label's box, else
    the page's only valid id. The name is the labelled one if plausible, else the
    reader's. readings has doc_id, page_no, field (id or name) and value, where a label was found.
    """
    value = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    labelled = labelled_values(words, (ID_LABEL, NAME_LABEL)).groupBy(*ON_PAGE).agg(value(ID_LABEL).alias("_i"), value(NAME_LABEL).alias("_n"))
    rows = pages.join(labelled, ON_PAGE, "left")
    for field in ("id", "name"):
        if readings is None:
            rows = rows.withColumn(f"_r{field}", F.lit(None).cast("string"))
        else:
            read = readings.where(F.col("field") == field).groupBy(*ON_PAGE).agg(F.min("value").alias(f"_r{field}"))
            rows = rows.join(read, ON_PAGE, "left")
    digits, alone = only_digits(F.col("_i")), valid_ids(F.coalesce("page_text", F.lit("")))
    read_id = F.when(F.col("_i").isNotNull() & (F.col("_rid") != ""), F.col("_rid"))
    owner = F.when(id_valid(digits), digits).when(read_id.isNotNull(), read_id).when(F.size(alone) == 1, alone[0]).otherwise("")
    read_name = F.when(F.col("_n").isNotNull() & (F.col("_rname") != ""), normalize(F.col("_rname")))
    name = F.when(plausible_name(F.col("_n")), normalize(name_letters(F.col("_n")))).otherwise(F.coalesce(read_name, F.lit("")))
    return rows.select(*ON_PAGE, owner.alias("id"), name.alias("name"))


def has_pattern(text: Column) -> Column:
    """A DN number, a province number or a labelled registry number."""
    return F.coalesce(text.rlike(DN) | text.rlike(PROVINCE) | text.rlike(LABEL), F.lit(False))


def official_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, official): the page has one of the patterns, a name label's box or an id label's value."""
    found = labelled_boxes(words, (NAME_LABEL, SPARE_LABEL)).select(*ON_PAGE).union(labelled_values(words, (ID_LABEL,)).select(*ON_PAGE)).distinct().withColumn("_label", F.lit(True))
    return pages.join(found, ON_PAGE, "left").select(*ON_PAGE, (has_pattern(F.col("page_text")) | F.coalesce("_label", F.lit(False))).alias("official"))


def official_documents(pages: DataFrame, words: DataFrame, first: int = OFFICIAL_PAGES) -> DataFrame:
    """(doc_id, official): any of the first pages is official."""
    return official_pages(pages, words).groupBy("doc_id").agg(F.coalesce(F.bool_or(F.when(F.col("page_no") <= first, F.col("official"))), F.lit(False)).alias("official"))


def multi_identity(pages: DataFrame) -> DataFrame:
    """(doc_id, n_ids, n_registry, multi): more than one valid id, or more than one registry number, in the pages' texts joined without anything between."""
    found = whole_text(pages).select("doc_id", F.size(valid_ids(F.col("text"))).alias("n_ids"), F.size(candidates(F.col("text"))).alias("n_registry"))
    return found.withColumn("multi", (F.col("n_ids") > 1) | (F.col("n_registry") > 1))


def name_quality(name: Column) -> Column:
    """clean (capitals only), light (and i or l), heavy, or not found."""
    return F.when(name == "", "not found").when(name.rlike("^[A-ZÇĞİÖŞÜ ]+$"), "clean").when(name.rlike("^[A-ZÇĞİÖŞÜil ]+$"), "light").otherwise("heavy")


def coverage(fields: DataFrame) -> DataFrame:
    """One row: documents, those with each field and all three, and names by quality."""
    has = lambda c: F.col(c) != ""
    quality = name_quality(F.col("name"))
    kinds = {k.replace(" ", "_"): F.count_if(quality == k).alias(f"n_{k.replace(' ', '_')}") for k in ("clean", "light", "heavy", "not found")}
    return fields.agg(F.count("*").alias("n_docs"), F.count_if(has("registry_no")).alias("n_registry"), F.count_if(has("national_id")).alias("n_id"), F.count_if(has("name")).alias("n_name"), F.count_if(has("registry_no") & has("national_id") & has("name")).alias("n_all"), *kinds.values())


def warning_counts(fields: DataFrame) -> DataFrame:
    """(warning, n) over all documents."""
    return fields.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))
