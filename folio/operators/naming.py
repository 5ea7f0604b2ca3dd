"""Free file names in order: a slug, or the slug with the least free number from 2.

Names interact inside a family, the slug without numbers at its end. Where a family has no slug that itself ends in a
number, and gives up no name, its requests get the free numbers in order: a request's number is its rank and the
taken numbers below, which are counted by running sums. Only the other families go through a fold, in order, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.scratch import cut

#: A family's rows are summed up in so many slices of their order, so that no task gets all rows of a large family.
SLICES = 128
RELEASE, REQUEST, USED = 0, 1, 2


def family(name: Column) -> Column:
    return F.regexp_replace(name, "(_[0-9]+)+$", "")


def running(rows: DataFrame, order: str, tie: str, value: str, name: str) -> DataFrame:
    """Column ``name``: the sum of ``value`` over a family's rows up to this one, in order of a number and then of ``tie``."""
    rows = cut(rows)
    least, most = rows.agg(F.min(order), F.max(order)).first()
    if least is None:
        return rows.withColumn(name, F.lit(None).cast("long"))
    width = F.lit((most - least) // SLICES + 1)
    rows = rows.withColumn("_slice", F.floor((F.col(order) - F.lit(least)) / width).cast("long"))
    before = F.sum("_sum").over(Window.partitionBy("family").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("family", "_slice").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    within = F.sum(value).over(Window.partitionBy("family", "_slice").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, ["family", "_slice"]).withColumn(name, (F.col("_before") + within).cast("long")).drop("_slice", "_before")


def _by_rank(requests: DataFrame, used: DataFrame) -> DataFrame:
    """(seq, slug, name) of requests (family, seq, slug) for the family's own name, beside used names (family, name)."""
    ranked = running(requests.withColumn("one", F.lit(1)), "seq", "seq", "one", "r")
    suffix = F.regexp_extract("name", r"_([1-9][0-9]{0,17})$", 1)
    number = F.when(F.col("name") == F.col("family"), F.lit(1)).when(F.col("name") == F.concat_ws("_", "family", suffix), suffix.cast("long"))
    taken = used.select("family", number.alias("t")).where("t = 1 or t > 1 and t is not null").distinct().withColumn("one", F.lit(1))
    taken = running(taken, "t", "t", "one", "i")
    free_below = F.col("t") - F.col("i")
    both = ranked.select("family", F.col("r").alias("key"), F.lit(0).alias("kind"), "seq", "slug").unionByName(taken.select("family", free_below.alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("slug")))
    placed = running(both, "key", "kind", "kind", "below").where("kind = 0").withColumn("number", F.col("key") + F.col("below"))
    return placed.select("seq", "slug", F.when(F.col("number") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("number").cast("string"))).alias("name"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (family, seq, step, name) in order, family by family."""
    own, taken, least_free = None, set(), {}
    for batch in batches:
        out = []
        for group, seq, step, name in zip(batch["family"], batch["seq"], batch["step"], batch["name"], strict=True):
            if group != own:
                own, taken, least_free = group, set(), {}
            if step == RELEASE:
                taken.discard(name)
                base, _, number = name.rpartition("_")
                if base in least_free and number.isdecimal():
                    least_free[base] = min(least_free[base], max(2, int(number)))
                continue
            free = name
            if step == REQUEST and free in taken:
                k = least_free.get(name, 2)
                while (free := f"{name}_{k}") in taken:
                    k += 1
                least_free[name] = k + 1
            taken.add(free)
            if step == REQUEST:
                out.append((seq, name, free))
        yield pd.DataFrame(out, columns=["seq", "slug", "name"])


def give_names(events: DataFrame) -> DataFrame:
    """(seq, slug, name) of each request, from rows (seq, step, name).

    Rows go by seq and step: a name is released (0), asked for (1) or, in rows before all others, used already (2).
    A released name is free for the requests after it. Without requests there are no rows.
    """
    rows = cut(events.withColumn("family", family(F.col("name"))))  # read several times below
    asked = F.count_if(F.col("step") == REQUEST)
    contested = F.bool_or((F.col("step") == RELEASE) | (F.col("step") == REQUEST) & (F.col("name") != F.col("family")))
    families = rows.groupBy("family").agg(asked.alias("_asked"), contested.alias("_contested")).where("_asked > 0").drop("_asked")
    rows = cut(rows.join(families, "family"))
    plain = rows.where("not _contested")
    ranked = _by_rank(plain.where(F.col("step") == REQUEST).select("family", "seq", F.col("name").alias("slug")), plain.where(F.col("step") == USED).select("family", "name"))
    ordered = rows.where("_contested").select("family", "seq", "step", "name").repartition("family").sortWithinPartitions("family", "seq", "step")
    return ranked.unionByName(ordered.mapInPandas(_fold, "seq long, slug string, name string"))
