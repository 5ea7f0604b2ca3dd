"""What readers and OCR made of a document, brought together.

fields is what ``extraction.extract`` returns. Readings are rows of their own; a missing row
means that there was nothing to read, an empty value that nothing could be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import digits_of, id_valid, plausible_name
from folio.operators.votes import merge_names, same_name


def needed_readings(fields: DataFrame) -> DataFrame:
    """(doc_id, field, page_no, box) that a reader has to look at: an empty id whose box is known, and an empty registry number, by its box or else the first page's top strip (field strip, null box)."""
    box = lambda name, kind: F.struct(F.lit(kind).alias("field"), F.col(f"{name}_page").alias("page_no"), F.col(f"{name}_box").alias("box"))
    strip = F.struct(F.lit("strip").alias("field"), F.lit(1).cast("int").alias("page_no"), F.col("registry_box").alias("box"))
    wanted = F.array(F.when((F.col("national_id") == "") & F.col("id_box").isNotNull(), box("id", "id")), F.when((F.col("registry_no") == "") & F.col("registry_box").isNotNull(), box("registry", "registry")).when(F.col("registry_no") == "", strip))
    return fields.select("doc_id", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.field", F.col("x.page_no").cast("int").alias("page_no"), "x.box")


def read_id(raw: Column) -> Column:
    found = digits_of(raw, 11, 11)
    return F.when(id_valid(found), found).otherwise(F.lit(""))


def read_registry(raw: Column) -> Column:
    return digits_of(raw, 4, 5)


def fill_numbers(fields: DataFrame, readings: DataFrame) -> DataFrame:
    """Empty ids and registry numbers from readings (doc_id, field, raw); what OCR gave is never overwritten.

    An id counts with eleven digits and a right checksum, and only where its label's box is known; a registry number with four
    or five digits, from the box where it is known and from the strip elsewhere. Each one that is taken adds a warning.
    """
    raw = readings.groupBy("doc_id").agg(*(F.min(F.when(F.col("field") == k, F.col("raw"))).alias(f"_{k}") for k in ("id", "registry", "strip")))
    rows = fields.join(raw, "doc_id", "left")
    one = F.when((F.col("national_id") == "") & F.col("id_box").isNotNull(), read_id(F.col("_id")))
    boxed = F.col("registry_box").isNotNull()
    two = F.when(F.col("registry_no") == "", read_registry(F.when(boxed, F.col("_registry")).otherwise(F.col("_strip"))))
    rows = rows.withColumn("_one", F.nullif(one, F.lit(""))).withColumn("_two", F.nullif(two, F.lit("")))
    added = F.array(F.when(F.col("_one").isNotNull(), "id read"), F.when(F.col("_two").isNotNull(), F.when(boxed, "registry read (box)").otherwise("registry read (strip)")))
    rows = rows.withColumn("national_id", F.coalesce("_one", "national_id")).withColumn("registry_no", F.coalesce("_two", "registry_no"))
    return rows.withColumn("warnings", F.concat("warnings", F.filter(added, lambda x: x.isNotNull()))).select(*fields.columns)


def reconcile(fields: DataFrame, votes: DataFrame | None = None, crops: DataFrame | None = None) -> DataFrame:
    """name, agreement (pages that agree), crossed and warnings of each document.

    votes is what ``votes.consensus`` returns, crops has doc_id and value where the name's line was cut out.
    An agreed name comes first, then the majority, then the crop, each corrected by OCR's if that is a plausible name; without
    votes and crops the name is OCR's. crossed: majority or crop and OCR agree but for marks, which is a second kind of trust.
    """
    rows = fields.join(votes, "doc_id", "left") if votes is not None else fields.withColumns({c: F.lit(None).cast(t) for c, t in (("majority", "string"), ("votes", "long"), ("agreed", "string"))})
    rows = rows.join(crops.select("doc_id", F.coalesce("value", F.lit("")).alias("_crop")), "doc_id", "left") if crops is not None else rows.withColumn("_crop", F.lit(None).cast("string"))
    read = F.coalesce(F.nullif("agreed", F.lit("")), F.nullif("majority", F.lit("")), "_crop")
    rows = rows.withColumn("_read", read).withColumn("_ok", F.col("_read").isNotNull() & plausible_name(F.col("name")))
    plain, merged = rows.where("not _ok"), merge_names(rows.where("_ok"), "_read", "name").withColumnRenamed("merged", "_name")
    rows = plain.withColumn("_name", F.coalesce("_read", "name")).unionByName(merged)
    crossed = (F.coalesce("agreed", F.lit("")) == "") & (F.coalesce("_read", F.lit("")) != "") & (F.col("name") != "") & same_name(F.col("_read"), F.col("name"))
    out = rows.withColumn("crossed", F.coalesce(crossed, F.lit(False)))
    warnings = F.when(F.col("crossed"), F.concat("warnings", F.array(F.lit("name read twice")))).otherwise(F.col("warnings"))
    return out.select("doc_id", F.col("_name").alias("name"), "national_id", "registry_no", F.coalesce("votes", F.lit(0)).cast("int").alias("agreement"), "crossed", warnings.alias("warnings"))
