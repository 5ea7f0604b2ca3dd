"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two texts link if the sets of their shingles of ``SHINGLE`` words have at least
``SIMILARITY`` in common, as a share of their union. Under one order of all shingles,
linked texts have a shingle in common among the first n - ceil(n * similarity) + 1 of
each, n being the text's number of shingles; so these are its keys, pairs that share
a key are candidates. Any order will do:
shingles that recur in a sample of the texts come last, the most frequent ones at the end, and the rest go by their hash, so
the sample decides what the search costs and not what it finds. A set's numbers of shingles in ``BINS``
parts of the hashes bound what two sets have in common; candidates whose bound is too low leave, and
only the others' whole sets are cut and compared.

Where two sets have their first key in common, no more than what is left of either can follow. With r
left of n shingles, that one included, a partner has at most r (1 + 1 / similarity) - n shingles, and at
least n * similarity. So pairs meet by key and step of size, the smaller set in the step of its own size and the larger
one in all steps that it may be paired with; and the smaller set only has keys there among its first
n - ceil(2 n * similarity / (1 + similarity)) + 1. Texts that have all but a ninth of their shingles in common are linked, so
boilerplate, which is last in the order, is no key of the smaller set unless it links the texts by itself.

SimHash comes first: each set has a fingerprint of its shingles, fingerprints within two bits are found through the tables of their distances
to reference fingerprints (``simhash_dedup.links``), and the sets behind them are candidates, verified like all others. Two texts of similarity 0.8 often
differ in more bits, so the search by shared shingles follows, which finds every pair.

A meeting of more than ``BUCKET`` smaller sets isn't paired up at once. In ``ROUNDS`` rounds its
sets are compared with one of them, and those that link are settled. Then the components
so far are found, and only pairs of different components are left, in steps of size ``FINE`` times as narrow: those with a
set outside the meeting's largest component.

Where those are more than ``BUCKET`` too (twice as many each further time), a meeting is dealt anew around a set c of shingles that most of a few of its sets have (c is no text's
set, and any c gives the same links). With D the shingles of c that a set lacks and T those that are in one of both, what two sets have in common is
|c| - |D| - |D'| + |T and T'|. So two sets either have enough in common by |D| and |D'| alone, and then both are
linked to the meeting's set of least |D| + n similarity / (1 + similarity), with which all are compared; or they share something of T, and they meet there again, by
as few of its shingles as that number leaves. What is still too large after ``LEVELS`` times is paired up as it is.

Pairs are written before they are looked up, compared or joined with others: the driver holds each query's plan, its small joined tables and
the news of its tasks, so many short queries leave it more room than a few long ones.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import broadcast_if_small, discard, materialize, small_batches
from folio.llm.simhash_dedup import _LOWER, SEED, components, links, majority

SHINGLE, SIMILARITY, BUCKET, ROUNDS = 5, Fraction(4, 5), 32, 2
#: Steps of size from a set to the largest that may be linked to it, and how many times as many where sets are still too many.
STEPS, FINE = 2, 16
#: How often a meeting is dealt anew, and about how many of its sets are asked for the shingles of most.
LEVELS, ASKED = 3, 32
#: Slices in which the sets of a large meeting are ranked.
SLICES = 64
#: One text of so many is in the sample; shingles with so many texts there come last, the most frequent ones up to a number.
SAMPLE, RECURS, LAST = 16, 2, 200_000
#: Parts of the hashes whose shingles are counted, up to MOST; a set with more in a part has no counts and no bound.
BINS, MOST = 256, 32_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; fewer words than ``size`` are one shingle."""
    words = text.translate(_LOWER).split()
    digest, join = xxhash.xxh64_digest, b" ".join
    cut = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words] if words else []
    return np.unique(np.frombuffer(b"".join([digest(join(x), SEED) for x in cut]), np.int64))


def name(found: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set as a signed long: the bits set in over half of its shingles' hashes."""
    return int(np.uint64(majority(found.view(np.uint8).reshape(-1, 8))).view(np.int64))


def binned(found: np.ndarray) -> np.ndarray | None:
    counts = np.bincount(found.view(np.uint64) // np.uint64((1 << 64) // BINS), minlength=BINS)
    return counts.astype(np.int16) if counts.max() <= MOST else None


def _read(docs: DataFrame, *more) -> DataFrame:
    return small_batches(docs).select(F.col("id"), F.col("text").cast("string").alias("text"), *more)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def common_order(docs: DataFrame, size: int):
    """A function that puts a set's shingles into the order of all shingles: those that recur in a sample of the rows (id, text) last, the others by their hash."""

    def every(batches):
        for batch in batches:
            found = [shingles(x.as_py() or b"", size) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["key"])

    sample = _read(docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).mapInArrow(every, "key long").groupBy("key").agg(F.count("*").alias("c"))
    last = sample.where(F.col("c") >= RECURS).orderBy(F.desc("c"), "key").limit(LAST).select("key", "c").toArrow()
    by_key = np.argsort(last.column(0).to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((last.column(0).to_numpy()[by_key], last.column(1).to_numpy()[by_key]))

    def ordered(s):
        recurring, often = shared.value
        if not len(recurring):
            return s
        at = np.minimum(np.searchsorted(recurring, s), len(recurring) - 1)
        return s[np.argsort(np.where(recurring[at] == s, often[at], 0), kind="stable")]

    return ordered


def keyed_sets(docs: DataFrame, size: int, similarity: Fraction, ordered) -> DataFrame:
    """(id, t, h, fp, n, bins, keys): name, fingerprint and size of the set of each row (id, t, text), its shingles' numbers by part, and its first ones in the common order."""

    def first(s):
        least = -(-len(s) * similarity.numerator // similarity.denominator)
        return ordered(s)[: len(s) - least + 1]

    def rows(batches):
        for batch in batches:
            found = [shingles(x.as_py() or b"", size) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([name(s) for s in found], pa.int64()), pa.array([fingerprint(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([binned(s) for s in found], pa.list_(pa.int16())), _lists([first(s) for s in found])], names=["id", "t", "h", "fp", "n", "bins", "keys"])

    return _read(docs, "t").mapInArrow(rows, "id long, t long, h long, fp long, n long, bins array<short>, keys array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, ordered) -> DataFrame:
    """(h, s): the sets of the names in ``wanted`` in the common order, cut anew from the rows with its ids and texts' hashes."""

    def rows(batches):
        for batch in batches:
            found = [(h, ordered(s)) for x, h in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True) if name(s := shingles(x.as_py() or b"", size)) == h]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), _lists([s for _, s in found])], names=["h", "s"])

    chosen = wanted.select("h", F.col("id").alias("i"), F.col("t").alias("u"))
    found = docs.join(broadcast_if_small(chosen), F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")))
    return _read(found, "h").mapInArrow(rows, "h long, s array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of the pairs (u, v) whose counts by part (h, n, bins) allow enough in common."""
    u, v = sets.select(F.col("h").alias("u"), F.col("n").alias("nu"), F.col("bins").alias("bu")), sets.select(F.col("h").alias("v"), F.col("n").alias("nv"), F.col("bins").alias("bv"))
    bound = F.aggregate(F.zip_with("bu", "bv", lambda a, b: F.least(a, b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    enough = bound * (similarity.numerator + similarity.denominator) >= (F.col("nu") + F.col("nv")) * similarity.numerator
    return pairs.join(u, "u").join(v, "v").where(F.coalesce(enough, F.lit(True))).select("u", "v")


def _verified(pairs: DataFrame, whole: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough."""
    u, v = whole.select(F.col("h").alias("u"), F.col("s").alias("su")), whole.select(F.col("h").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    enough = both * (similarity.numerator + similarity.denominator) >= (F.size("su") + F.size("sv")) * F.lit(similarity.numerator).cast("long")
    return pairs.join(u, "u").join(v, "v").where(enough).select("u", "v")


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of the sets (h, fp) to compare by their fingerprints: each with the first one of its own, and the first ones of two that link."""
    first = materialize(sets.groupBy("fp").agg(F.min("h").alias("first")))
    same = sets.join(first, "fp").where("h <> first").select(F.col("first").alias("u"), F.col("h").alias("v"))
    of = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}h"))
    linked = materialize(links(first.select("fp"))).join(of("u"), "u").join(of("v"), "v")
    return same.unionByName(linked.select(F.least("uh", "vh").alias("u"), F.greatest("uh", "vh").alias("v")))


def _step(n, similarity: Fraction, steps: int):
    return F.floor(F.log(n.cast("double")) * (steps / math.log(similarity.denominator / similarity.numerator)))


def meetings(keyed: DataFrame, similarity: Fraction, steps: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, step, h, n, left) of the smaller and of the larger sets, from (key, h, n, left); left is what is left of n from the key on."""
    num, den = similarity.numerator, similarity.denominator
    n, left = F.col("n"), F.col("left")
    most = F.floor(left * (num + den) / num) - n
    small = keyed.where(most >= n).withColumn("step", _step(n, similarity, steps))
    least = F.ceil(n * num / den)
    large = keyed.where(F.least(n, most) >= least).withColumn("step", F.explode(F.sequence(_step(least, similarity, steps), _step(F.least(n, most), similarity, steps))))
    columns = ("key", "step", "h", "n", "left")
    return small.select(*columns), large.select(*columns)


def _paired(small: DataFrame, large: DataFrame, similarity: Fraction, on: list[str], *also) -> DataFrame:
    """Pairs (u, v) of a smaller and a larger set that meet and can be similar enough by what is left of them."""
    x = small.withColumnsRenamed({"h": "x", "n": "nx", "left": "lx", "root": "rx", "beside": "bx", "e": "ex"})
    y = large.withColumnsRenamed({"h": "y", "n": "ny", "left": "ly", "root": "ry", "beside": "by", "e": "ey"})
    num, den = similarity.numerator, similarity.denominator
    c = F.col
    order = (c("nx") < c("ny")) | ((c("nx") == c("ny")) & (c("x") < c("y")))
    fits = (c("nx") * den >= c("ny") * num) & (F.least("lx", "ly") * (num + den) >= (c("nx") + c("ny")) * num)
    pairs = x.join(y, on).where(order & fits)
    for condition in also:
        pairs = pairs.where(condition)
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _settle(small: DataFrame, large: DataFrame, similarity: Fraction, check) -> list[DataFrame]:
    """Edges of ``ROUNDS`` rounds in which the sets of each meeting are compared with one smaller set of it; those that link leave.

    That one is the set with the most meetings: the fewer shingles of its own a copy has, the more keys it shares with the other copies. Each round takes the next one.
    """
    on, found = ["key", "step"], []
    weight = small.groupBy("h").agg(F.count("*").alias("weight"))
    first = F.slice(F.reverse(F.array_sort(F.collect_list("x"))), 1, ROUNDS)
    ranked = small.join(weight, "h").select(*on, F.struct("weight", F.xxhash64("h").alias("g"), "h", "n", "left").alias("x"))
    centres = materialize(_foremost(ranked, on).groupBy(*on).agg(first.alias("x")).select(*on, F.posexplode("x").alias("round", "x")).select(*on, "round", "x.h", "x.n", "x.left"))
    for k in range(ROUNDS):
        centre = centres.where(F.col("round") == k).drop("round")
        pairs = _paired(centre, large, similarity, on).unionByName(_paired(small, centre, similarity, on))
        found.append(check(materialize(pairs.distinct())))
        if k + 1 < ROUNDS:
            of = centre.select(*on, F.col("h").alias("centre"))
            linked = found[-1].union(found[-1].select("v", "u")).toDF("h", "centre").withColumn("linked", F.lit(True))
            rest = lambda rows: rows.join(of, on, "left").join(linked, ["h", "centre"], "left").where("linked is null").drop("centre", "linked")  # noqa: E731, B023
            small, large = materialize(rest(small)), materialize(rest(large))
    return found


def _foremost(ranked: DataFrame, on: list[str]) -> DataFrame:
    """Of the structs x of each meeting the greatest ones of each of its slices by hash, ``ROUNDS`` for each, so that no task sorts a whole meeting."""
    slices = ranked.withColumn("slice", F.pmod("x.g", F.lit(SLICES)).cast("int"))
    place = F.row_number().over(Window.partitionBy(*on, "slice").orderBy(F.desc("x")))
    return slices.withColumn("place", place).where(F.col("place") <= ROUNDS).drop("slice", "place")


def _outer(small: DataFrame, large: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs of different components, of which one is outside the largest of its meeting."""
    c, inside = F.col, F.col("root") == F.col("largest")
    also = (c("rx") != c("ry"), F.least("bx", "by") * (2 * (similarity.numerator + similarity.denominator)) >= c("ex") + c("ey"))
    x, y = (lambda rows, where: rows.where(where).drop("largest")), F.lit(True)
    return _paired(x(small, ~inside), x(large, y), similarity, ["meeting"], *also).unionByName(_paired(x(small, inside), x(large, ~inside), similarity, ["meeting"], *also))


def _anew(small: DataFrame, large: DataFrame, whole: DataFrame, similarity: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (u, v) of each set of a meeting and the one nearest to what most of it have, and its smaller and larger sets where they meet again."""
    num, den, c = similarity.numerator, similarity.denominator, F.col
    both = small.withColumn("small", F.lit(True)).unionByName(large.withColumn("small", F.lit(False)))
    members = materialize(both.groupBy("meeting", "h", "n", "root", "largest").agg(F.bool_or("small").alias("smaller"), F.bool_or(~c("small")).alias("larger")))
    inside = members.where("root = largest")
    share = inside.groupBy("meeting").agg(F.count("*").alias("members"))
    asked = inside.join(share, "meeting").where(F.pmod(F.xxhash64("h", "meeting"), c("members")) < ASKED).select("meeting", "h")
    votes = asked.join(whole, "h").select("meeting", F.explode("s").alias("shingle")).groupBy("meeting", "shingle").agg(F.count("*").alias("votes"))
    most = votes.join(asked.groupBy("meeting").agg(F.count("*").alias("voters")), "meeting").where("2 * votes > voters")
    most = materialize(most.groupBy("meeting").agg(F.collect_list("shingle").alias("most")))
    lacks, more = F.array_except("most", "s"), F.array_except("s", "most")
    most = members.join(whole, "h").join(most, "meeting", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    e = 2 * (F.size(lacks).cast("long") * (num + den) + c("n") * num) - F.size("most").cast("long") * (num + den)
    members = materialize(most.select(*members.columns, F.concat(more, F.array_sort(lacks)).alias("t"), e.alias("e")))
    nearest = F.min_by(F.struct(c("h").alias("x"), c("root").alias("rx")), F.struct("e", "h")).alias("nearest")
    of = materialize(members.groupBy("meeting").agg(nearest, F.min("e").alias("least"), F.min(F.when(c("root") != c("largest"), c("e"))).alias("least_outside")))
    rows = members.join(of, "meeting")
    near = rows.where((c("root") != c("nearest.rx")) & (c("h") != c("nearest.x"))).select(F.least("h", "nearest.x").alias("u"), F.greatest("h", "nearest.x").alias("v"))
    size = F.size("t").cast("long")
    least = F.greatest(F.lit(1), F.ceil((c("e") + F.when(c("root") == c("largest"), c("least_outside")).otherwise(c("least"))) / (2 * (num + den))))
    first = F.slice("t", 1, F.greatest(size - least + 1, F.lit(0)).cast("int"))
    rows = rows.select(*members.columns, F.posexplode(first).alias("at", "shingle"))
    rows = rows.select(F.xxhash64("meeting", "shingle").alias("meeting"), "h", "n", c("n").alias("left"), "root", (size - c("at")).alias("beside"), "e", "smaller", "larger")
    rows = materialize(rows)
    return near, rows.where("smaller").drop("smaller", "larger"), rows.where("larger").drop("smaller", "larger")


def _outside(small: DataFrame, large: DataFrame, whole: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs (u, v) to compare so that the components (column root) of all sets that meet become whole."""
    found = []
    for level in range(LEVELS + 1):
        sizes = small.groupBy("meeting", "root").agg(F.count("*").alias("c"))
        largest = materialize(sizes.groupBy("meeting").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), (F.sum("c") - F.max("c")).alias("outside")))
        beyond = large.join(largest, "meeting").where("root <> largest").groupBy("meeting").agg(F.count("*").alias("beyond"))
        wide = F.greatest("outside", F.coalesce("beyond", F.lit(0))) > (BUCKET << level)
        marked = materialize(largest.join(beyond, "meeting", "left").select("meeting", "largest", wide.alias("wide")))
        small, large = (materialize(rows.join(marked, "meeting")) for rows in (small, large))
        if level == LEVELS or marked.where("wide").isEmpty():
            found.append(materialize(_outer(small.drop("wide"), large.drop("wide"), similarity)))
            break
        of = lambda rows, where: rows.where(where).drop("wide")
        found.append(materialize(_outer(of(small, "not wide"), of(large, "not wide"), similarity)))
        near, small, large = _anew(of(small, "wide"), of(large, "wide"), whole, similarity)
        found.append(materialize(near))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(docs: DataFrame, classes: DataFrame, ordered, size: int = SHINGLE, similarity: Fraction = SIMILARITY, equal_rows: bool = False) -> DataFrame:
    """(node, root) of the distinct sets (h, id, t, fp, n, bins, keys) that are linked to any.

    ``classes`` is a written table, which is deleted on the way.
    """
    keyed = classes.select("h", "n", F.posexplode("keys").alias("at", "key")).select("key", "h", "n", (F.col("n") - F.col("at")).alias("left"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    keyed = materialize(keyed.join(shared, "key", "left_semi"))
    sets = materialize(classes.drop("keys", "fp").join(keyed.select("h").distinct(), "h", "left_semi"))
    near = materialize(near_fingerprints(classes.select("h", "fp")))
    discard(classes)
    small, large = meetings(keyed, similarity, STEPS)
    on = ["key", "step"]
    met = materialize(small.groupBy(*on).agg(F.count("*").alias("smaller")))
    few, many = met.where(F.col("smaller") <= BUCKET).select(*on), met.where(F.col("smaller") > BUCKET).select(*on)
    pairs = materialize(near.unionByName(_paired(small.join(few, on, "left_semi"), large, similarity, on)).distinct())
    pairs = materialize(_possible(pairs, sets, similarity))
    crowded = not many.isEmpty()
    if crowded:
        crowd = materialize(keyed.join(many.select("key").distinct(), "key", "left_semi"))
    wanted = pairs.select(F.col("u").alias("h")).union(pairs.select("v"))
    wanted = (wanted.union(crowd.select("h")) if crowded else wanted).distinct()
    whole = whole_sets(docs, sets.select("h", "id", "t").join(wanted, "h", "left_semi"), size, ordered)
    whole = materialize(whole.dropDuplicates(["h"]) if equal_rows else whole)
    edges = materialize(_verified(pairs, whole, similarity))
    if not crowded:
        return components(edges)

    check = lambda pairs: materialize(_verified(materialize(_possible(pairs, sets, similarity)), whole, similarity))
    settled = _settle(small.join(many, on, "left_semi"), large.join(many, on, "left_semi"), similarity, check)
    for more in settled:
        edges = edges.unionByName(more)
    found = materialize(components(edges))
    small, large = meetings(crowd, similarity, FINE * STEPS)
    rooted = lambda rows: rows.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    met = lambda rows: rooted(rows).select(F.xxhash64(*on).alias("meeting"), "h", "n", "left", "root", F.col("left").alias("beside"), (2 * similarity.numerator * F.col("n")).alias("e"))
    last = check(materialize(_outside(materialize(met(small)), materialize(met(large)), whole, similarity)))
    return found if last.isEmpty() else components(found.toDF("u", "v").unionByName(last))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """id, component_id (the least id linked through any chain) and t (the text's hash) of each row.

    Texts without words, null ones too, are copies of each other; texts of any length are read whole. Rows with a null id take part and are
    returned, their component_id is null if no row of their group has an id. Rows that repeat an id come back as often,
    each with the group of its own text. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    ordered = common_order(docs, size)
    found = materialize(keyed_sets(docs, size, similarity, ordered))
    rows = materialize(found.select("id", "t", "h"))
    equal_rows = not rows.groupBy("id", "t").count().where("count > 1").isEmpty()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t")).alias("x")
    kept = F.first(F.struct("fp", "n", "bins", "keys")).alias("y")  # equal in all rows of a set
    classes = materialize(found.groupBy("h").agg(first, kept).select("h", "x.id", "x.t", "y.fp", "y.n", "y.bins", "y.keys"))
    discard(found)
    least = materialize(classes.select("h", "id"))
    linked = roots(docs, classes, ordered, size, similarity, equal_rows).withColumnRenamed("node", "h")
    least = least.join(linked, "h", "left").withColumn("root", F.coalesce("root", "h"))
    members = least.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("h", "component_id")
    return rows.join(members, "h").select(F.col("id").alias(id_col), "component_id", "t")
