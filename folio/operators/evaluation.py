"""Results against hand-made truth, and seeded samples.

Null and empty values are missing ones. Samples go by a hash of the id and the seed, equal hashes by id; a sample larger
than the table is the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(truth: Column, found: Column) -> Column:
    return F.when(F.coalesce(truth, F.lit("")) == "", "unmeasurable").when(F.coalesce(found, F.lit("")) == "", "missed").when(truth == found, "right").otherwise("wrong")


def pairing(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), "neither").when(a == "", "second only").when(b == "", "first only").when(a == b, "agree").otherwise("contradict")


def precision_coverage(rows: DataFrame, *by: str) -> DataFrame:
    """Right, wrong and missed per group; precision is right of produced, coverage produced of measurable."""
    o = outcome(F.col("truth"), F.col("found"))
    n = lambda kind: F.count_if(F.col("o") == kind)
    made = n("right") + n("wrong")
    return rows.withColumn("o", o).groupBy(*by).agg(n("right").alias("n_right"), n("wrong").alias("n_wrong"), n("missed").alias("n_missed"), F.round(F.try_divide(n("right"), made), 6).alias("precision"), F.round(F.try_divide(made, made + n("missed")), 6).alias("coverage"))


def accuracy(rows: DataFrame, kind: str, methods: list[str]) -> DataFrame:
    """Hits of each method by kind, and over all kinds in row (all)."""
    totals = rows.rollup("method", kind).agg(F.count_if("hit").alias("n"), F.grouping(kind).alias("all")).where("method is not null")
    named = totals.withColumn("kind", F.when(F.col("all") == 1, "(all)").otherwise(F.col(kind)))
    return named.groupBy("kind").pivot("method", methods).agg(F.first("n"))


def _draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that the seed fixes."""
    return df.orderBy(_draw(id_col, seed), id_col).limit(n)


def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed: int) -> DataFrame:
    """About n times its share from each stratum (rounded half to even), topped up to n from the rest.

    Only rows that may be chosen are ranked: the first n of each stratum.
    """
    quota = df.groupBy(stratum).agg(F.count("*").alias("c"))
    total = quota.agg(F.sum("c").alias("t"))
    quota = quota.join(F.broadcast(total)).select(stratum, F.bround(F.lit(float(n)) * F.col("c") / F.col("t")).alias("quota"))
    rows = df.withColumn("_h", _draw(id_col, seed)).withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col))).where(F.col("_k") <= n)
    rows = rows.join(quota, stratum).withColumn("_own", F.col("_k") <= F.col("quota"))
    return rows.orderBy(F.desc("_own"), "_h", id_col).limit(n).select(*df.columns)


def map_runs(maps: DataFrame) -> DataFrame:
    """(doc_id, letter, first_page, last_page): the runs of equal letters of each map (doc_id, map), in page order; empty and null maps have none."""
    runs = F.regexp_extract_all("map", F.lit(r"((.)\2*)"), F.lit(1))
    rows = maps.select("doc_id", F.posexplode(runs).alias("k", "run"))
    last = F.sum(F.length("run")).over(Window.partitionBy("doc_id").orderBy("k")).cast("int")
    rows = rows.withColumn("last_page", last)
    return rows.select("doc_id", F.substring("run", 1, 1).alias("letter"), (F.col("last_page") - F.length("run") + 1).alias("first_page"), "last_page")


def split_agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_same, n_cuts, n_found and n_shared of each document with a true map, from maps (doc_id, map).

    Pages agree where runs of one letter overlap; cuts are the pages at which a new run begins. A found map may be missing, shorter or longer:
    n_pages are the true map's, and a cut counts as shared only at the same page.
    """
    a, b = map_runs(truth), map_runs(found).withColumnsRenamed({"letter": "l", "first_page": "f", "last_page": "t"})
    overlap = (F.least("last_page", "t") - F.greatest("first_page", "f") + 1).cast("long")
    met = a.join(b, "doc_id").where((F.col("first_page") <= F.col("t")) & (F.col("f") <= F.col("last_page")))
    same = met.groupBy("doc_id").agg(F.sum(F.when(F.col("letter") == F.col("l"), overlap).otherwise(F.lit(0))).alias("n_same"), F.count_if((F.col("first_page") == F.col("f")) & (F.col("f") > 1)).alias("n_shared"))
    cuts = lambda runs, page, name: runs.groupBy("doc_id").agg(F.count_if(F.col(page) > 1).alias(name))
    rows = truth.select("doc_id", F.length(F.coalesce("map", F.lit(""))).cast("long").alias("n_pages"))
    for more in (same, cuts(a, "first_page", "n_cuts"), cuts(b, "f", "n_found")):
        rows = rows.join(more, "doc_id", "left")
    return rows.select("doc_id", "n_pages", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_same", "n_cuts", "n_found", "n_shared")))


def split_counts(flagged: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row: flagged documents (doc_id), those without a primary person, those that split by themselves and those left to a person; analysis is ``pages.document_analysis``."""
    rows = flagged.select("doc_id").distinct().join(analysis.select("doc_id", "primary", "splittable"), "doc_id")
    none, split = F.col("primary").isNull(), F.coalesce("splittable", F.lit(False))
    return rows.agg(F.count("*").alias("n_flagged"), F.count_if(none).alias("n_skipped"), F.count_if(split).alias("n_splittable"), F.count_if(~none & ~split).alias("n_by_hand"))
