"""Removal of repeated byte strings by sampled prefix doubling.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier in
the collection: in a document of smaller id, or earlier in the same document.

Names stand for ranks: equal strings, and only they, get equal names. In each document
the name of the 2n bytes at a position comes from the pair of names at the position and
n bytes on, for n = 1, 2, 4 .. 64. To sort a pair for each position of the collection at
each offset would move a hundred times the input, so Spark sorts sampled positions:

1. A window of ``length`` bytes is anchored at the position with the least name of
   ``anchor`` bytes in it (leftmost of equals). The choice depends on the window's bytes
   alone, so equal windows have equal anchors. Windows next to each other that share an
   anchor form a run, one row.
2. Spark counts anchor names. A run whose anchor name is unique is unique and leaves; the
   others are sorted by (anchor name, run name), and one whose pair occurs earlier is
   repeated as a whole.
3. Of the first runs of pairs, those that share an anchor with another pair go on: their
   windows are sorted by (anchor name, window name), and a window that isn't the first of
   its pair is repeated.

Names have 64 bits and are compared in pairs, so as 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, materialize, small_batches

ANCHOR = 48
LENGTH = 100
#: Bytes that are named at a time, and bits of a key that hold a position in such a block.
BLOCK, BITS = 1 << 19, 24
#: Ranges in which texts without an id of their own are numbered.
RANGES = 128
U = np.uint64


def _mixed(x):
    """The finisher of splitmix64, on whole arrays."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_NAMES = _mixed((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))


def _pair(a, b):
    x = a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(29))


class Names:
    """Names of the strings of 4, 32, 48 (an anchor) and 64 bytes at each position of a block."""

    def __init__(self, data: np.ndarray):
        h, self.by = _BYTE_NAMES[data], {}
        for n in (1, 2, 4, 8, 16, 32):
            h = _pair(h[: max(0, len(h) - n)], h[n:])
            if 2 * n in (4, 32, 64):
                self.by[2 * n] = h
        half = self.by[32]
        self.by[ANCHOR] = _pair(half[: max(0, len(half) - ANCHOR + 32)], half[ANCHOR - 32 :])

    def window(self, at: np.ndarray) -> np.ndarray:
        """Names of the strings of 100 bytes at these positions."""
        return _mixed(_pair(_pair(self.by[64][at], self.by[32][at + 64]), self.by[4][at + 96]))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbours."""
    n, done = len(keys) - width + 1, 1
    while 2 * done <= width:
        keys = np.minimum(keys[: len(keys) - done], keys[done:])
        done *= 2
    return np.minimum(keys[:n], keys[width - done : width - done + n])


def _blocks(offsets: np.ndarray):
    """(first document, one past the last, first byte, one past the last) of blocks; a long document takes several, which overlap."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK:
            yield i, j, lo, hi
        else:
            for at in range(lo, hi - LENGTH + 1, BLOCK):
                yield i, j, at, min(hi, at + BLOCK + LENGTH - 1)
        i = j


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Arrays for all documents: document, offset in it, number of windows, anchor name, run name."""
    parts = []
    for i, j, lo, hi in _blocks(offsets):
        if hi - lo < LENGTH:
            continue
        names = Names(data[lo:hi])
        keys = (names.by[ANCHOR] & ~U((1 << BITS) - 1)) | np.arange(hi - lo - ANCHOR + 1, dtype=U)
        anchor = (_least(keys, LENGTH - ANCHOR + 1) & U((1 << BITS) - 1)).astype(np.int64)
        begin = np.maximum(offsets[i:j], lo) - lo
        last = np.minimum(offsets[i + 1 : j + 1], hi) - lo - LENGTH
        first = np.unique(np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, begin[last >= begin]]))
        doc = np.searchsorted(begin, first, "right") - 1
        keep = first <= last[doc]
        first, doc = first[keep], doc[keep]
        if not len(first):
            continue
        end = np.minimum(np.append(first[1:] - 1, len(anchor)), last[doc])
        run = _mixed(_pair(names.window(first), names.window(end)) + (end - first).astype(U))
        parts.append((doc + i, first + lo - offsets[doc + i], end - first + 1, names.by[ANCHOR][anchor[first]], run))
    if not parts:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, U)] * 2
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _seen(ids, offs, a, b):
    """True where an earlier (id, offset) of the same batch has the same pair of names."""
    order = np.lexsort((offs, ids, b, a))
    a, b, ids, offs = a[order], b[order], ids[order], offs[order]
    n = len(a)
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    out = np.empty(n, bool)
    out[order] = (ids != ids[head]) | (offs != offs[head])
    return out


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _spread(names, seen, ids, offs):
    """Rows that are settled already get a name of their own, so that no task gets them all."""
    return np.where(seen, _mixed(ids.astype(U) * U(0x9E3779B97F4A7C15) + offs.astype(U)), names)


def _run_rows(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _utf8(batch.column(1))
        doc, off, n, anchor, run = _runs(data, offsets)
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        seen = _seen(ids, off, anchor, run)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(_spread(anchor, seen, ids, off).view(np.int64)), pa.array(run.view(np.int64)), pa.array(seen)],
            names=["id", "off", "n", "a", "b", "seen"],
        )


def _window_rows(batches):
    """From (id, text, runs) the rows of the runs' single windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        runs, each = batch.column(2), [[], [], [], []]
        at, flat = np.asarray(runs.offsets), runs.values
        off, n, a = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("off", "n", "a"))
        for k in range(batch.num_rows):
            own = slice(at[k], at[k + 1])
            size = int(offsets[k + 1] - offsets[k])
            for o, m, name in zip(off[own].tolist(), n[own].tolist(), a[own], strict=True):
                if o + m + LENGTH - 1 <= size:
                    lo = int(offsets[k]) + o
                    each[0].append(np.full(m, ids[k]))
                    each[1].append(np.arange(o, o + m))
                    each[2].append(np.full(m, name))
                    each[3].append(Names(data[lo : lo + m + LENGTH - 1]).window(np.arange(m)))
        if not each[0]:
            continue
        own, off, name, window = (np.concatenate(x) for x in each)
        name = name.astype(np.int64).view(U)
        seen = _seen(own, off, name, window)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(off.astype(np.int32)), pa.array(_spread(name, seen, own, off).view(np.int64)), pa.array(window.view(np.int64)), pa.array(seen)],
            names=["id", "off", "a", "b", "seen"],
        )


def _cut(data: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes left of a document, and the number of maximal removed runs."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.minimum(off, len(data)), 1)
    np.add.at(change, np.minimum(off + n - 1 + LENGTH, len(data)), -1)
    gone = np.cumsum(change[:-1]) > 0
    return data[~gone], int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _results(with_text: bool):
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _utf8(batch.column(1))
            runs = batch.column(2)
            at, flat = np.asarray(runs.offsets), runs.values
            off, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("off", "n"))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            out = [[], [], [], [], []]
            for k in range(batch.num_rows):
                own = slice(at[k], at[k + 1])
                text = data[offsets[k] : offsets[k + 1]]
                kept, spans = _cut(text, off[own], n[own]) if at[k] < at[k + 1] else (text, 0)
                kept = kept.tobytes()
                values = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), None if null[k] else kept.decode("utf-8", "ignore"))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            arrays = [batch.column(0), batch.column(3), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            names = ["id", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(out[4], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (id, text, rest) with an id of their own for each text where ids are null or repeat: their place in the order of id (null last) and the text's hash."""
    odd = docs.groupBy("id").count().where("count > 1 or id is null")
    if odd.isEmpty():
        return docs
    docs = docs.withColumn("h", F.xxhash64("text"))
    order = [F.asc_nulls_last("id"), F.asc("h")]
    ranged = materialize(docs.select("id", "h").distinct().repartitionByRange(RANGES, *order).withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")  # ``RANGES`` rows at most
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    numbers = materialize(ranged.join(F.broadcast(starts), "range").select(F.col("id").alias("i"), F.col("h").alias("g"), place.alias("place")))
    return docs.join(numbers, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select(F.col("place").alias("id"), "text", "rest")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove every byte covered by a string of 100 bytes that also starts earlier.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: the
    bytes left, as text (a character of which a byte went is left out; null stays null).
    Null and empty texts have no bytes; texts under 100 bytes lose nothing; texts of any length are worked off in blocks that
    overlap. Rows with a null id come after all others; different texts of one id go by their hashes. Rows with equal id and text count as one document
    at one place: neither removes the other, and both come back. The columns ``keep`` come
    back too; others, whatever their names, are ignored. An empty table gives no rows.
    """
    own = F.col(id_col).cast("long")
    extra = F.struct(own.alias("_id"), *keep or [])
    docs = _placed(small_batches(docs).select(own.alias("id"), F.col(text_col).cast("string").alias("text"), extra.alias("rest")))
    docs = docs.where("id is not null")  # which they are; else only one of the joins below would ask for it, and they'd not share their shuffle
    runs = docs.select("id", "text").mapInArrow(_run_rows, "id long, off int, n short, a long, b long, seen boolean")
    placed = Window.partitionBy("a", "b").orderBy("id", "off")
    # No task gets all runs of an anchor: what anchors have in common is summed up before it is shuffled, and joined back.
    anchors = runs.where("not seen").groupBy("a").agg(F.count("*").alias("c"), (F.min("b") != F.max("b")).alias("kinds"))
    anchors = materialize(anchors.where("c > 1").select("a", "kinds"))
    marked = (
        runs.join(anchors, "a", "left")
        .where("seen or kinds is not null")
        .withColumn("rank", F.rank().over(placed))
        .select("id", "off", "n", "a", (F.col("seen") | (F.col("rank") > 1)).alias("whole"), "kinds")
        .where("whole or kinds")
    )
    marked = materialize(marked)
    discard(anchors)
    open_runs = marked.where("not whole").groupBy("id").agg(F.collect_list(F.struct("off", "n", "a")).alias("runs"))
    # The windows' rows keep the same columns as the results' below, so both joins share one shuffle of the texts.
    windows = docs.join(open_runs, "id").select("id", "text", "runs", "rest").mapInArrow(_window_rows, "id long, off int, a long, b long, seen boolean")
    again = windows.withColumn("rank", F.rank().over(placed)).where("seen or rank > 1").select("id", "off", F.lit(1).cast("short").alias("n"))
    gone = marked.where("whole").select("id", "off", "n").unionByName(again).groupBy("id").agg(F.collect_list(F.struct("off", "n")).alias("runs"))
    schema = f"id long, rest {docs.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    empty = F.expr("cast(array() as array<struct<off:int,n:smallint>>)")
    done = docs.join(gone, "id", "left").select("id", "text", F.coalesce("runs", empty).alias("runs"), "rest").mapInArrow(_results(with_text), schema)
    return done.select(F.col("rest._id").alias(id_col), *(F.col(f"rest.{c}") for c in keep or []), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
