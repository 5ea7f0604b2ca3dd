"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Vectors are scaled to length one at most and get one more component that makes the
largest inner product the least distance. Each of ``CURVES`` curves projects them to
``DIMS`` random directions, adds a random shift and orders them along a Hilbert curve;
Spark cuts each order into ranges of about equal size. Queries of ranges next to each
other form a block, which is compared with the ranges around it on every curve: the
points pass by in batches and each query keeps its best, so a task's memory doesn't grow
with the points it meets. The curves' results merge by exact score.

How many ranges on each side is found out first: the exact neighbours of a bounded set of
queries show how far they lie from their query on its nearest curve. Equal vectors are one
candidate, which stands for its ``k`` + 1 least ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize

CURVES, DIMS, ORDER = 8, 6, 8
#: Vectors in a range, and ranges of a curve at most.
RANGE_ROWS, RANGES = 256, 4096
#: Ranges of a curve whose queries are compared together, at most.
BLOCK_RANGES = 32
#: Queries with exact results that set how many ranges are searched, the share of neighbours to reach on them, and keys that set the ranges' bounds.
SAMPLE_QUERIES, TARGET, SAMPLE_KEYS = 64, 0.96, 40_000


def hilbert(points: np.ndarray) -> np.ndarray:
    """Positions on a Hilbert curve of points with ``ORDER`` bits in each column (Skilling's transposed form)."""
    x, n = points.astype(np.uint64).T.copy(), points.shape[1]
    one = np.uint64(1)
    for bit in range(ORDER - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for i in range(n):
            up = (x[i] >> np.uint64(bit)) & one == one
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(len(points), np.uint64)
    for bit in range(ORDER - 1, 0, -1):
        t ^= np.where((x[n - 1] >> np.uint64(bit)) & one == one, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= t
    key = np.zeros(len(points), np.uint64)
    for bit in range(ORDER - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


class Curves:
    """The random directions and shifts of all curves for one dimension, and the keys they give."""

    def __init__(self, dim: int, longest: float, seed: int = 5):
        r = np.random.default_rng(seed)
        self.longest = longest
        self.axes = [np.linalg.qr(r.standard_normal((dim + 1, min(DIMS, dim + 1))))[0] for _ in range(CURVES)]
        self.shifts = [r.uniform(0, 1, a.shape[1]) for a in self.axes]

    def keys(self, vectors: np.ndarray, tie: np.ndarray, query: bool) -> np.ndarray:
        """Keys by curve; ``tie`` spreads equal points over a curve's last bits."""
        length = np.linalg.norm(vectors, axis=1)
        scale = np.where(length > 0, length, 1) if query else np.full(len(vectors), self.longest)
        x = vectors / scale[:, None]
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))[:, None]])
        width = 2.5 / np.sqrt(x.shape[1])  # most of a random projection lies within this
        out = []
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            cell = (x @ axes / width + 1) / 2 * (1 << (ORDER - 1)) + shift * (1 << (ORDER - 1))
            out.append((hilbert(np.clip(cell, 0, (1 << ORDER) - 1)) << np.uint64(12)) | (tie.astype(np.uint64) & np.uint64(4095)))
        return np.stack(out).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Columns of each row's k highest scores, and of all that may tie with the last of them if every score is off by up to ``slack``."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] - 2 * slack


class Best:
    """The k best points of each of a block's queries; points come in batches and aren't kept."""

    def __init__(self, dim: int, k: int):
        self.k, self.q, self.qr = k, np.empty((0, dim)), np.empty(0, np.int64)
        self.least, self.found = np.empty(0), []

    def queries(self, reps: np.ndarray, vectors: np.ndarray):
        self.q, self.qr = np.vstack([self.q, vectors]), np.append(self.qr, reps)
        self.least = np.full(len(self.qr), -np.inf)

    def points(self, reps: np.ndarray, vectors: np.ndarray):
        for at in range(0, len(self.q), 256):
            q = self.q[at : at + 256]
            rough = q @ vectors.T
            slack = 1e-9 * np.abs(rough).max()
            i, j = np.nonzero(_best(rough, self.k, slack) & (rough + slack >= self.least[at : at + 256, None]))
            if len(i):
                self.found.append((i + at, reps[j], np.add.reduce(q[i] * vectors[j], axis=1)))
        if sum(len(x[0]) for x in self.found) > 4 * self.k * len(self.qr):
            self._cut()

    def _cut(self):
        if not self.found:
            return
        i, reps, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((reps, -score, i))
        i, reps, score = i[order], reps[order], score[order]
        n = np.arange(len(i)) - np.searchsorted(i, i)
        last = n == self.k - 1
        self.least[i[last]] = score[last]
        self.found = [(i[n < self.k], reps[n < self.k], score[n < self.k])]

    def rows(self):
        self._cut()
        for i, reps, score in self.found:
            yield pa.RecordBatch.from_arrays([pa.array(self.qr[i]), pa.array(reps), pa.array(score)], names=["q", "rep", "score"])


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``, itself left out.

    Vectors that are null or zero, or hold null or non-finite components, take no part, nor
    do rows without an id; of vectors of several lengths only those of the commonest length
    count. Ties go to the smaller id; rows that repeat an id and a vector count once. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    vec = F.col("vec")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vec")).where("id is not null and vec is not null")
    clean = clean.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    sizes = clean.groupBy(F.size(vec).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["dim"]
    clean = clean.where(F.size(vec) == dim).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    ids = clean.select("id", "vec", "part").distinct().withColumn("class", F.xxhash64("vec"))
    # The k + 1 least ids of each class, first within parts so that no class meets in one task.
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("class", "vec", "part").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("class", "vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = materialize(few.groupBy("class", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asked = materialize(ids.where(F.pmod("id", F.lit(every)) == 0).select("id", "class"))
    queries = classes.join(asked.select("class").distinct(), "class", "left_semi")

    longest = classes.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    n = classes.count()
    ranges = int(min(RANGES, max(1, n // RANGE_ROWS)))
    curves = Curves(dim, longest)

    def keyed(query: bool):
        def rows(batches):
            for b in batches:
                tie = b.column("class").to_numpy()
                for c, key in enumerate(curves.keys(_matrix(b.column("vec")), tie, query) if b.num_rows else []):
                    yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key)], names=["rep", "curve", "key"])

        return rows

    keys = classes.select("rep", "class", "vec").mapInArrow(keyed(False), "rep long, curve int, key long")
    sample = keys.where(F.pmod(F.xxhash64("rep", "curve"), F.lit(max(1, n * CURVES // SAMPLE_KEYS))) == 0).toArrow().to_pandas()
    bounds = [np.quantile(own, np.arange(1, ranges) / ranges, method="nearest") if len(own := np.sort(sample["key"][sample["curve"] == c].to_numpy())) else np.empty(0, np.int64) for c in range(CURVES)]

    def placed(query: bool):
        def rows(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                tie = b.column("class").to_numpy()
                for c, key in enumerate(curves.keys(_matrix(b.column("vec")), tie, query)):
                    at = np.searchsorted(bounds[c], key, "right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vec"), pa.array(np.full(b.num_rows, c, np.int32)), pa.array(at)], names=["rep", "vec", "curve", "at"])

        return rows

    schema = "rep long, vec array<double>, curve int, at int"
    points = classes.select("rep", "class", "vec").mapInArrow(placed(False), schema)
    seekers = queries.select("rep", "class", "vec").mapInArrow(placed(True), schema)
    reach = _reach(classes, queries, points, seekers, k, ranges)

    # Queries of ``width`` ranges form a block; a point goes to each block that has a query within reach of it.
    width = min(BLOCK_RANGES, max(1, reach))
    block = lambda x: F.floor(x / width).cast("int")
    sides = F.sequence(block(F.greatest(F.col("at") - reach, F.lit(0))), block(F.least(F.col("at") + reach, F.lit(ranges - 1))))
    rows = seekers.select("curve", block(F.col("at")).alias("block"), F.lit(False).alias("point"), "rep", "vec")
    rows = rows.unionByName(points.select("curve", F.explode(sides).alias("block"), F.lit(True).alias("point"), "rep", "vec"))
    rows = rows.repartition("curve", "block").sortWithinPartitions("curve", "block", "point")  # a block's queries before its points

    def compared(batches):
        own, best = None, None
        for b in batches:
            place = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("curve", "block", "point")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if own != (key := tuple(place[:2, lo])):
                    if best is not None:
                        yield from best.rows()
                    own, best = key, Best(dim, k + 1)
                part = b.slice(lo, hi - lo)
                (best.points if place[2, lo] else best.queries)(part.column("rep").to_numpy(), _matrix(part.column("vec")))
        if best is not None:
            yield from best.rows()

    near = rows.mapInArrow(compared, "q long, rep long, score double")
    near = near.distinct().withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1).select("q", "rep", "score")
    # A class among the k + 1 best gives its least ids; each query then leaves itself out.
    found = near.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    by_query = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    answers = asked.join(classes.select("class", F.col("rep").alias("q")), "class").join(by_query, "q")
    hits = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(hits)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))


def _reach(classes: DataFrame, queries: DataFrame, points: DataFrame, seekers: DataFrame, k: int, ranges: int) -> int:
    """Ranges to search on each side so that ``TARGET`` of some queries' exact neighbours are met."""
    some = queries.orderBy(F.xxhash64("rep", F.lit(1))).limit(SAMPLE_QUERIES).select("rep", "vec").toArrow().to_pandas()
    if not len(some):
        return 0
    q, qr = np.array(some["vec"].tolist()), some["rep"].to_numpy()

    def scored(batches):
        for b in batches:
            if b.num_rows:
                rough = q @ _matrix(b.column("vec")).T
                i, j = np.nonzero(_best(rough, k + 1, 1e-9 * np.abs(rough).max(initial=0.0)))
                yield pa.RecordBatch.from_arrays([pa.array(qr[i]), pa.array(b.column("rep").to_numpy()[j]), pa.array(rough[i, j])], names=["q", "rep", "score"])

    exact = classes.select("rep", "vec").mapInArrow(scored, "q long, rep long, score double").where("q <> rep")
    exact = exact.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k).select("q", "rep")
    exact = F.broadcast(exact)  # SAMPLE_QUERIES times k rows
    own = F.broadcast(seekers.where(F.col("rep").isin(qr.tolist())).select(F.col("rep").alias("q"), "curve", F.col("at").alias("q_at")))
    there = points.select("rep", "curve", "at").join(exact, "rep").join(own, ["q", "curve"]).groupBy("q", "rep").agg(F.min(F.abs(F.col("at") - F.col("q_at"))).alias("d"))
    away = np.sort(there.toArrow().to_pandas()["d"].to_numpy())
    return int(min(ranges - 1, away[min(len(away) - 1, int(np.ceil(TARGET * len(away))))])) if len(away) else 0
