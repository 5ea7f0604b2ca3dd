"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``WINDOW`` words in a row of a benchmark item (an item of fewer words is one
window of its own length). Of each window only the least hash of ``GRAM`` words is kept
as a fingerprint, so a text and an item that share a window share a fingerprint. Texts
that share none are settled by that join; in the rest, the hits are extended: each of
their positions is compared with the windows themselves, by two hashes of 64 bits that
take every word of the window.

Arrays are unnested by the outer functions, followed by a filter: from the others Spark
infers a filter on the array's size, moves it below the steps that widen the array and
there writes out every step as often as the next one refers to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, broadcast_if_small, materialize

WINDOW, GRAM = 10, 8
#: A text's two hashes, which stand for it.
KEY = ["k1", "k2"]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; none for null."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _beside(name: str, by: int, what) -> Column:
    """``what`` of each element and the one ``by`` places on; shorter by ``by``."""
    left = F.greatest(F.size(name) - by, F.lit(0))
    return F.zip_with(F.slice(name, 1, left), F.slice(name, by + 1, left), what)


def _widened(df: DataFrame, name: str, to: int, what) -> DataFrame:
    """Combine each ``to`` neighbours of array column ``name``: by doubling, then one overlapping step."""
    done = 1
    while done < to:
        by = min(done, to - done)
        df = df.withColumn(name, _beside(name, by, what))
        done += by
    return df


def with_grams(df: DataFrame, name: str, n: int, salt: int = 0) -> DataFrame:
    """Add array column ``name`` with a hash for each ``n`` words in a row of column ``w``."""
    df = df.withColumn(name, F.transform("w", lambda x: F.xxhash64(F.lit(salt), x)))
    return _widened(df, name, n, lambda a, b: F.xxhash64(a, b))


def with_fingerprints(df: DataFrame, name: str, n: int) -> DataFrame:
    """Add the fingerprints of all windows of ``n`` words: minima of gram hashes, or whole windows if short."""
    if n < WINDOW:
        return with_grams(df, name, n)
    df = with_grams(df, name, GRAM)
    return _widened(df, name, WINDOW - GRAM + 1, lambda a, b: F.least(a, b)).withColumn(name, F.array_distinct(name))


def _item_windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(class, n, a, b): the windows of each class of items with equal words."""
    parts = []
    for n in lengths:
        own = items.where(F.size("w") >= WINDOW) if n == WINDOW else items.where(F.size("w") == n)
        own = with_grams(with_grams(own, "a", n), "b", n, 1)
        parts.append(own.select("class", F.lit(n).alias("n"), F.inline_outer(F.arrays_zip("a", "b"))).where("a is not null").distinct())
    return reduce(DataFrame.unionByName, parts)


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a text's two hashes, ``KEY``, as columns."""
    return docs.withColumn("k1", F.xxhash64(text_col)).withColumn("k2", F.xxhash64(F.lit(1), text_col))


def hits(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, k2, n_hit, ids) of the texts that hold a window, from rows (k1, k2, text); ids is null if only items without an id have it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where("size(w) > 0")
    items = items.groupBy("w").agg(F.collect_set("item").alias("ids")).withColumn("class", F.xxhash64("w"))  # null ids aren't collected
    items = materialize(items)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(WINDOW))).distinct().collect())  # ten values at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, n_hit long, ids array<string>")

    marked, prints = docs.select(*KEY, words(F.col("text")).alias("w")), []
    for n in lengths:
        own = with_fingerprints(items.where(F.size("w") >= WINDOW) if n == WINDOW else items.where(F.size("w") == n), "f", n)
        prints.append(own.select(F.explode_outer("f").alias("f")).where("f is not null").distinct())
        marked = with_fingerprints(marked, f"f{n}", n)
    prints = reduce(DataFrame.union, prints).distinct()
    marked = marked.select(*KEY, F.explode_outer(F.concat(*(f"f{n}" for n in lengths))).alias("f"))
    marked = materialize(marked.join(broadcast_if_small(prints), "f", "left_semi").select(*KEY).distinct())

    near = docs.join(broadcast_if_small(marked), KEY, "left_semi").select(*KEY, words(F.col("text")).alias("w"))
    windows = materialize(_item_windows(items, lengths))
    at = []
    for n in lengths:
        own = with_grams(with_grams(near, "a", n), "b", n, 1)
        at.append(own.select(*KEY, F.posexplode_outer(F.arrays_zip("a", "b")).alias("pos", "x")).where("pos is not null").select(*KEY, "pos", "x.a", "x.b", F.lit(n).alias("n")))
    known = broadcast_if_small(windows.select("a", "b", "n").distinct())
    found = materialize(reduce(DataFrame.unionByName, at).join(known, ["a", "b", "n"], "left_semi").distinct())

    before = Window.partitionBy(*KEY).orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n")
    covered = found.select(*KEY, "pos", "n").distinct().withColumn("from", F.greatest(F.col("pos"), F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = covered.groupBy(*KEY).agg(F.sum(F.greatest(end - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    classes = found.select(*KEY, "a", "b", "n").distinct().join(broadcast_if_small(windows), ["a", "b", "n"]).select(*KEY, "class").distinct()
    ids = classes.join(items.select("class", F.explode("ids").alias("item")), "class").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("ids"))
    return materialize(covered.join(ids, KEY, "left"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated for each document.

    A word is hit if it lies in any occurrence of a window. Null and empty texts have no
    words and no hits; items without words match nothing; words of an item without an id are hit, but it isn't counted or listed; an empty benchmark leaves
    every document clean. Items with equal words are joined as one class, whose ids are
    then listed; an id that several items have is listed once. Every row is a document of its
    own, whatever its id: ids may be null or repeat, and copies of a text get the same hits.
    Texts of any length are read whole. Other columns, whatever their names, are ignored.
    """
    docs = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    found = hits(docs, benchmark, item_col, item_text_col)
    rows = docs.select("id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(broadcast_if_small(found), KEY, "left").select(F.col("id").alias(id_col), "n_words", *_outcome())


def _outcome() -> list[Column]:
    ids, n_hit = F.coalesce("ids", F.expr("cast(array() as array<string>)")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return [n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")]
