"""What people have to look at to label documents: one crop where it's clear, else ranges of pages.

Page numbers run from 1. Documents without pages have no ranges; a page that is marked twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.scratch import cut

# Fixed value: the margin of a crop in points.
MARGIN = 6.0


def line_crop(box: Column, width: Column, height: Column) -> Column:
    """A value's line from the page's left edge to a margin behind the value, inside the page."""
    return F.struct(
        F.lit(0.0).alias("x0"),
        F.greatest(box["y0"] - MARGIN, F.lit(0.0)).alias("y0"),
        F.least(box["x1"] + MARGIN, width).alias("x1"),
        F.least(box["y1"] + MARGIN, height).alias("y1"),
    )


def page_ranges(marked: DataFrame, last_pages: DataFrame, beside: int = 0) -> DataFrame:
    """(doc_id, first_page, last_page): the marked pages (doc_id, page_no) and ``beside`` pages on either side, as ranges that neither touch nor overlap.

    last_pages has doc_id and last_page; ranges end there, and at page 1.
    """
    rows = marked.select("doc_id", "page_no").distinct().join(last_pages, "doc_id")
    rows = rows.withColumns({"_from": F.greatest(F.col("page_no") - beside, F.lit(1)), "_to": F.least(F.col("page_no") + beside, F.col("last_page"))})
    order = Window.partitionBy("doc_id").orderBy("_from", "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("_from") > before + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("_range", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "_range").agg(F.min("_from").alias("first_page"), F.max("_to").alias("last_page")).drop("_range")


def label_work(gold: DataFrame, ids: DataFrame, id_boxes: DataFrame, registry_boxes: DataFrame, sizes: DataFrame, beside: int = 0) -> DataFrame:
    """doc_id, field (id or registry), kind (crop or pages), first_page, last_page and box of each view to show.

    gold has doc_id, national_id and registry_no; a document needs labels if either is missing (null or blank). ids has a page's distinct valid ids (doc_id, page_no, ids),
    with a row for each page; the boxes have doc_id, page_no and box, sizes page_width and page_height.

    The id's view is the crop of the first box of an id's label if the document has exactly one valid id; else the pages with a valid id, and page 1. The registry number's is
    the crop of its first box, else page 1. ``beside`` adds pages around those with an id.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    last = ids.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    complete = gold.where(~blank(F.col("national_id")) & ~blank(F.col("registry_no"))).select("doc_id").distinct()
    todo = cut(last.join(complete, "doc_id", "left_anti"))  # read several times below, like the id's crops
    pages = ids.join(todo.select("doc_id"), "doc_id")
    counts = pages.select("doc_id", F.explode("ids").alias("id")).groupBy("doc_id").agg(F.count_distinct("id").alias("n"))

    def first_crops(boxes: DataFrame, field: str) -> DataFrame:
        one = boxes.groupBy("doc_id").agg(F.min_by(F.struct("page_no", "box"), "page_no").alias("b")).select("doc_id", "b.page_no", "b.box")
        crop = line_crop(F.col("box"), F.col("page_width"), F.col("page_height"))
        return one.join(sizes, ["doc_id", "page_no"]).select("doc_id", F.lit(field).alias("field"), F.lit("crop").alias("kind"), F.col("page_no").alias("first_page"), F.col("page_no").alias("last_page"), crop.alias("box"))

    single = todo.select("doc_id").join(counts.where("n = 1").select("doc_id"), "doc_id")
    id_crops = cut(first_crops(id_boxes.join(single, "doc_id"), "id"))
    registry_crops = first_crops(registry_boxes.join(todo.select("doc_id"), "doc_id"), "registry")

    def whole(ranges: DataFrame, field: str) -> DataFrame:
        return ranges.select("doc_id", F.lit(field).alias("field"), F.lit("pages").alias("kind"), "first_page", "last_page", F.lit(None).cast(id_crops.schema["box"].dataType).alias("box"))

    unclear = todo.join(id_crops.select("doc_id"), "doc_id", "left_anti")
    marked = pages.where(F.size("ids") > 0).select("doc_id", "page_no").join(unclear.select("doc_id"), "doc_id")
    ranges = page_ranges(marked, unclear, beside).unionByName(unclear.select("doc_id", F.lit(1).alias("first_page"), F.lit(1).alias("last_page")))
    ranges = page_ranges(ranges.select("doc_id", F.explode(F.sequence("first_page", "last_page")).alias("page_no")), unclear)
    without = todo.join(registry_crops.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("first_page"), F.lit(1).alias("last_page"))
    return id_crops.unionByName(whole(ranges, "id")).unionByName(registry_crops).unionByName(whole(without, "registry"))
