"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in order of their code points (null last) weigh 5, 2, 1 and again from 5. They
share ``SHARE`` times all words; a target stops at ``MOST`` times its source's words and
the excess is shared again by weight. A source's rate (target over words) gives every
document so many certain whole copies; the fraction left, f, is the mean chance of one more,
over the source's words. Longer documents have the better chances: a document's p is
f + f (1 - f) (2 m - 1), where m is the share of the source's words that lie in shorter
documents (and half of those in documents about as long), so p stays between 0 and 1 and the
expected words of the sample are what is left of the target. Documents are ranked by the odds
of a random number over the odds of their own p, and the first
ones in that order are taken as long as their words fit into what is left of the target;
the last place goes to the remaining document that comes nearest to what is missing.

The order within a source is found without sorting the source: sums by slices of the
ranking number show in which slice the target is reached, and only that slice is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import broadcast_if_small, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows that a slice of the ranking number has on average, of all sources together, and the least number of slices.
SLICE_ROWS, LEAST_SLICES = 20_000, 1024
#: Documents count as about as long if their lengths lie in the same of so many steps from one power of two to the next.
LENGTH_STEPS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    sums = sums.withColumn("weight", weight).withColumn("most", F.lit(MOST) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = sums.withColumn("level", (F.sum("source_size").over(every) * F.lit(SHARE) - full) / rest)  # with those before at their most
    level = level.withColumn("level", F.max("level").over(every))
    return level.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def chances(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, step, p) from rows (source, step, size) and (source, source_size, f): the chance of one more copy."""
    sums = sizes.groupBy("source", "step").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).join(goals.select(F.col("source").alias("s"), "source_size", "f"), F.col("source").eqNullSafe(F.col("s")))
    middle = F.when(F.col("source_size") > 0, (F.col("before") + F.col("words") / 2) / F.col("source_size")).otherwise(F.lit(0.5))
    return sums.select("source", "step", (F.col("f") + F.col("f") * (1 - F.col("f")) * (2 * middle - 1)).alias("p"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """id, source, size, source_size, target and taken (words, repeats counted) of each document.

    Null and empty texts have no words and give none; texts of any length count whole. A null source is a source of its
    own, the last. Ids may be null; rows that repeat an id share one random number, and equal rows come back as often, each
    one a document; the last place goes to one of them. Equal ranks go by id, then size. An empty table gives
    no rows. Equal ids and texts give equal results on every run. Other columns, whatever their names, are ignored.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"))
    sizes = materialize(sizes.withColumn("step", F.floor(F.log2(F.col("size") + 1) * LENGTH_STEPS).cast("int")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(sizes).withColumn("whole", F.floor(rate)).withColumn("f", rate - F.col("whole"))
    goals = materialize(goals.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))
    slices = max(LEAST_SLICES, sizes.count() // SLICE_ROWS)

    p = materialize(chances(sizes, goals)).withColumnsRenamed({"source": "s", "step": "t"})
    odds = lambda x: x / (F.lit(1.0) - x)
    rank = odds(F.col("u")) / odds(F.col("p"))
    ranked = sizes.join(broadcast_if_small(p), F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t"))).drop("s", "t", "step")
    ranked = ranked.withColumn("key", F.when(F.col("p") > 0, rank / (1 + rank)).otherwise(F.lit(1.0)))
    ranked = ranked.withColumn("slice", F.floor(F.col("key") * slices).cast("long"))

    sums = ranked.groupBy("source", "slice").agg(F.sum("size").alias("size")).join(goals.select(F.col("source").alias("s"), "missing"), F.col("source").eqNullSafe(F.col("s")))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("slice"))
    sums = sums.withColumn("before", upto - F.col("size")).where(F.col("before") <= F.col("missing"))
    edge = sums.groupBy("s").agg(F.max("slice").alias("edge"), F.max("before").alias("before"))
    goals = materialize(goals.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))

    rows = ranked.join(broadcast_if_small(goals.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = rows.where("slice = edge").withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("extra", (F.col("upto") <= F.col("missing")) & (F.col("p") > 0))
    outside = rows.where("edge is null or slice <> edge").withColumn("upto", F.lit(None).cast("long")).withColumn("extra", F.coalesce(F.col("slice") < F.col("edge"), F.lit(False)) & (F.col("p") > 0))
    rows = materialize(inside.unionByName(outside).withColumn("no", F.monotonically_increasing_id()))  # tells equal rows apart, once written

    reached = rows.where("extra").groupBy("source").agg(F.sum("size").alias("got")).select(F.col("source").alias("s"), "got")
    left = goals.join(reached, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), (F.col("missing") - F.coalesce("got", F.lit(0))).alias("gap"))
    gap = F.abs(F.col("size") - F.col("gap"))
    last = rows.where("not extra and p > 0").join(broadcast_if_small(left), F.col("source").eqNullSafe(F.col("s"))).where(gap < F.col("gap"))
    last = last.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "key", "id", "size", "no")).alias("x")).select(F.col("source").alias("s"), F.col("x.no").alias("last"))
    rows = rows.join(broadcast_if_small(last), F.col("source").eqNullSafe(F.col("s")), "left")
    copies = F.col("whole") + (F.col("extra") | F.coalesce(F.col("no") == F.col("last"), F.lit(False))).cast("long")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
