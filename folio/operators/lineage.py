"""Moves of processed files, applied in order.

processed has hash, source and target; moves have seq (unique), old, new and source. A move changes each row that is at its old
target or comes from its source: to its new target, and to its source. A move that changes no row leaves one of its own, under the hash
``hedef:`` and the old target. Nulls equal nothing; empty strings are values like others.

After a move a row's target and source are the move's, so the next move that changes it is the same for all rows the move changed:
the first later one with that target as old, or that source. A row's last move is found by doubling: each step follows as many moves as all steps before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.scratch import cut

# Fixed value: what stands before the old target in the hash of a row that a move leaves.
UNKNOWN = "hedef:"


def _next_moves(moves: DataFrame) -> DataFrame:
    """(seq, next): the first later move that changes what this one changed; null if none does."""
    target, source = F.lit("target").alias("by"), F.lit("source").alias("by")
    asks = lambda by, name: moves.select(by, F.col(name).alias("name"), "seq", F.lit(0).alias("answers"))
    answers = lambda by, name: moves.select(by, F.col(name).alias("name"), "seq", F.lit(1).alias("answers"))
    rows = asks(target, "new").unionByName(answers(target, "old")).unionByName(asks(source, "source")).unionByName(answers(source, "source"))
    rows = rows.where("name is not null")
    # From the end; at one seq the question comes before the answer, as a move isn't its own next one.
    later = Window.partitionBy("by", "name").orderBy(F.desc("seq"), "answers").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(F.col("answers") == 1, F.col("seq")), True).over(later))
    return moves.select("seq").join(rows.where("answers = 0").groupBy("seq").agg(F.min("next").alias("next")), "seq", "left")


def _last_moves(following: DataFrame) -> DataFrame:
    """(seq, last) from (seq, next)."""
    now = cut(following.select("seq", F.coalesce("next", "seq").alias("last")))
    while True:
        ahead = now.select(F.col("seq").alias("last"), F.col("last").alias("_further"))
        step = cut(now.join(ahead, "last").select("seq", F.col("_further").alias("last"), (F.col("_further") > F.col("last")).alias("_moved")))
        now = step.select("seq", "last")
        if step.where("_moved").isEmpty():
            return now


def retarget(processed: DataFrame, moves: DataFrame) -> DataFrame:
    """hash, source and target of the processed rows after all moves, and of the rows that moves left.

    Of several moves that leave a row under one hash the last one's stays. Equal processed rows stay as often as they occur. Without moves nothing
    changes; without processed rows only moves' own rows are left.
    """
    rows = processed.select("hash", "source", "target")
    moves = cut(moves.select(F.col("seq").cast("long").alias("seq"), "old", "new", "source"))
    following = cut(_next_moves(moves))
    last = _last_moves(following)
    by_target = moves.where("old is not null").groupBy(F.col("old").alias("target")).agg(F.min("seq").alias("_one"))
    by_source = moves.where("source is not null").groupBy("source").agg(F.min("seq").alias("_two"))
    rows = rows.join(by_target, "target", "left").join(by_source, "source", "left").withColumn("_first", F.least("_one", "_two"))

    changed = following.select(F.col("next").alias("seq")).union(rows.select("_first")).where("seq is not null").distinct()
    left = moves.join(changed, "seq", "left_anti").groupBy("old").agg(F.max("seq").alias("seq"))
    own = left.select(F.concat(F.lit(UNKNOWN), "old").alias("hash"), "seq").join(last, "seq").select("hash", "last")

    to = moves.select(F.col("seq").alias("last"), F.col("source").alias("_source"), F.col("new").alias("_new"))
    moved = rows.join(last.withColumnRenamed("seq", "_first"), "_first", "left").join(to, "last", "left")
    moved = moved.select("hash", F.when(F.col("last").isNotNull(), F.col("_source")).otherwise(F.col("source")).alias("source"), F.when(F.col("last").isNotNull(), F.col("_new")).otherwise(F.col("target")).alias("target"))
    kept = moved.join(own.select("hash"), "hash", "left_anti")  # a row under a hash that a move leaves is replaced
    return kept.unionByName(own.join(to, "last").select("hash", F.col("_source").alias("source"), F.col("_new").alias("target")))
