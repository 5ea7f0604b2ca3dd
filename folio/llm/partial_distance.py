"""Vector codes by product quantisation, with partial-distance search.

Vectors become integers and are cut into parts; each part position has a codebook, and a
vector's code is the nearest entry of each part. Codebooks are bounded (``PARTS`` times
``ENTRIES`` entries), so they go to every task; tasks return sums and counts by entry, which
Spark adds up, and the driver only ever sees the new codebooks.

The nearest entry is found dimension by dimension, those of the largest variance in the
codebook first: a vector's distance to every entry grows with each dimension, and entries
leave as soon as theirs exceeds the distance of the best entry known in full. The best one
so far is the entry that is nearest in the first dimensions; whatever ties stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import broadcast_if_small, materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared at once, and dimensions taken before the first entries leave.
BLOCK, FIRST = 256, 2
#: Largest squared distance of two vectors; those with components that could exceed it don't take part.
MOST = 1 << 62


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of ``book`` nearest to each row of ``x``; ties go to the lower entry."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    entry, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        entry[at : at + BLOCK], least[at : at + BLOCK] = _nearest(x[at : at + BLOCK], book)
    return entry, least


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((len(x), len(book)), np.int64)
    for j in range(min(FIRST, x.shape[1])):
        sums += (x[:, j, None] - book[None, :, j]) ** 2
    best = _complete(x, book, sums.argmin(axis=1))
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for j in range(FIRST, x.shape[1]):
        sums += (x[row, j] - book[entry, j]) ** 2
        if j == 2 * FIRST:  # more is known, so the entry that leads now is a better one to beat
            starts = np.searchsorted(row, np.arange(len(x)))
            lead = np.flatnonzero(sums == np.minimum.reduceat(sums, starts)[row])
            lead = lead[np.searchsorted(row[lead], np.arange(len(x)))]
            best = np.minimum(best, _complete(x, book, entry[lead]))
        stays = sums <= best[row]
        row, entry, sums = row[stays], entry[stays], sums[stays]
    starts = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(sums, starts)
    ties = np.flatnonzero(sums == least[row])  # entries of a row are in ascending order
    return entry[ties[np.searchsorted(row[ties], np.arange(len(x)))]], least


def _complete(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - book[entry]) ** 2).sum(axis=1)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """First and last place of each part; where they can't be equal, later parts are longer."""
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, x): floor(scale * component) of the rows that take part."""
    row = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    row = row.where("v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = row.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = lengths[0] if lengths else 1
    most = int((MOST // (4 * n)) ** 0.5) // scale
    return row.where(F.size("v") == n).where(F.forall("v", lambda x: F.abs(x) < most)).select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def _rounds(table: DataFrame, books: list[np.ndarray], shared) -> list[np.ndarray]:
    """The codebooks after one round."""
    width = max(b.shape[1] for b in books)
    length = sum(b.shape[1] for b in books)

    def sums(batches):
        found = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in shared.value]
        for batch in batches:
            x = _matrix(batch.column(0))
            for (first, last), book, (total, count) in zip(cuts(length, len(found)), shared.value, found, strict=True):
                entry, _ = nearest(x[:, first:last], book)
                np.add.at(total, entry, x[:, first:last])
                count += np.bincount(entry, minlength=len(count))
        for p, (total, count) in enumerate(found):
            used = np.flatnonzero(count)
            wide = np.zeros((len(used), width), np.int64)
            wide[:, : total.shape[1]] = total[used]
            columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), *map(pa.array, wide.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    added = table.select("x").mapInArrow(sums, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{j}" for j in range(width)))))
    books = [b.copy() for b in books]
    for part, entry, n, *s in added.collect():  # an entry of a codebook each
        books[part][entry] = [v // n for v in s[: books[part].shape[1]]]
    return books


def codebooks(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final codebook of each part position, from rows (id, x); none if there are no rows."""
    first = table.orderBy(F.col("id").isNull(), "id", "x").limit(entries).select("x").collect()
    if not first:
        return []
    start = np.array([r.x for r in first], np.int64)
    books = [start[:, a:b] for a, b in cuts(start.shape[1], parts)]
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(books)
        books = _rounds(table, books, shared)
        shared.unpersist()
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each vector that takes part.

    Vectors that are null, empty, or hold null or non-finite components don't take part, nor
    do those of another length than the commonest (of equally common ones the longest), or
    with components so large that a distance might exceed a long (at 64 dimensions, from about
    131,000). Codebooks start from the first rows by id, then by vector; null ids come
    last, rows that repeat count as often as they occur, and with fewer rows the codebooks have fewer entries. A length that
    the number of parts doesn't divide gives parts that differ by one; parts without a dimension
    have code 00. Equal labels, nulls together, share a label_error, which is
    null if a long can't hold it. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    table = materialize(integers(small_batches(vectors), id_col, vec_col, label_col, scale))
    books = codebooks(table, parts, entries, rounds)
    digits = len(f"{max(entries - 1, 0):x}") if entries > ENTRIES else 2
    shared = table.sparkSession.sparkContext.broadcast(books)

    def codes(batches):
        for batch in batches:
            x, error, code = _matrix(batch.column(2)), np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for (first, last), book in zip(cuts(x.shape[1], len(shared.value)), shared.value, strict=True):
                entry, distance = nearest(x[:, first:last], book) if last > first else (np.zeros(len(x), np.int64), 0)
                error += distance
                code = [c + format(e, f"0{digits}x") for c, e in zip(code, entry, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], names=["id", "label", "code", "error"])

    kind = table.schema["label"].dataType.simpleString()
    coded = materialize(table.mapInArrow(codes, f"id long, label {kind}, code string, error long"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    found = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of ``encode`` over embeddings of one length that ``parts`` divides."""
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) x
FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0))""",
        f"p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] x FROM v, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r AS e, x FROM p WHERE r < {entries})",
    ]
    apart = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, x, min(struct_pack(d := CAST(d AS BIGINT), e := e)) m FROM (SELECT p.r, p.part, p.x, b.e, {apart} d FROM p JOIN b{k} b USING (part)) GROUP BY ALL)")
        if k < rounds:
            means = f"SELECT part, m.e e, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) c FROM (SELECT part, m, unnest(x) c, generate_subscripts(x, 1) i FROM a{k}) GROUP BY ALL"
            steps.append(f"n{k} AS (SELECT part, e, list(c ORDER BY i) x FROM ({means}) GROUP BY ALL), b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(n{k}.x, b{k}.x) x FROM b{k} LEFT JOIN n{k} USING (part, e))")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) s FROM b{rounds})")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) code, CAST(sum(m.d) AS BIGINT) error FROM a{rounds} GROUP BY r)")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, s AS codebooks_sha256 FROM v JOIN c USING (r), h"
