"""Vector codes against plain quantisation, and their edge cases."""

import hashlib
import math
from collections import defaultdict

import numpy as np

from folio.llm import partial_distance
from folio.llm.partial_distance import cuts, encode, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries, rounds, parts=4):
    """{position in order: (code, error)}, label errors and the digest; rows are (id, ints, label)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    codes, errors, every = defaultdict(str), defaultdict(int), []
    for a, b in cuts(len(rows[0][1]), parts):
        x = [r[1][a:b] for r in rows]
        book = [x[i] for i in order[:entries]]
        apart = lambda p, q: sum((u - v) ** 2 for u, v in zip(p, q))
        for k in range(rounds + 1):
            to = [min(range(len(book)), key=lambda e: (apart(p, book[e]), e)) for p in x]
            if k < rounds:
                for e in range(len(book)):
                    if own := [p for p, t in zip(x, to) if t == e]:
                        book[e] = [sum(c) // len(own) for c in zip(*own)]
        for i, t in enumerate(to):
            codes[i] += f"{t:02x}"
            errors[i] += apart(x[i], book[t])
        every += [c for entry in book for c in entry]
    labels = defaultdict(int)
    for i, r in enumerate(rows):
        labels[r[2]] += errors[i]
    return [(r[0], codes[i], errors[i], labels[r[2]]) for i, r in enumerate(rows)], hashlib.sha256(",".join(map(str, every)).encode()).hexdigest()


def by_text(rows):
    return sorted(map(str, rows))


def test_nearest_is_the_plain_search():
    rng = np.random.default_rng(3)
    for spread in (2, 50, 100_000):
        x, book = rng.integers(-spread, spread, (700, 16)), rng.integers(-spread, spread, (90, 16))
        book[40] = book[7]  # a tie
        apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, least = nearest(x, book)
        assert (entry == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()


def test_against_plain_quantisation(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 3, [float(v) for v in np.float32(rng.normal(0, 0.1, 10))], i % 3 or None) for i in range(150)]
    rows += [(None, rows[5][1], None), (rows[7][0], rows[7][1], 1), (rows[7][0], rows[8][1], 1)]
    want, digest = brute([(i, [math.floor(1024 * np.float32(c)) for c in v], l) for i, v, l in rows], 20, 4)
    found = encode(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=20).collect()
    assert {r.codebooks_sha256 for r in found} == {digest}
    assert by_text(tuple(r)[:4] for r in found) == by_text(want)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, -inf, 0.0, 0.0], [1.0] * 5, [3e38, 0.0, 0.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(100, [0.5, -0.5, 0.25, 0.0], 1), (101, [0.5, -0.5, 0.25, 0.001], None)]
    found = {r.vec_id: r for r in encode(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {100, 101} and found[101].code == "00000001" or found[101].code == "00000000"
    assert sum(r.error for r in found.values()) == 0


def test_short_vectors_empty_tables_and_extra_columns(spark):
    rows = [(1, [0.5, 1.0], 1, "x", "y"), (2, [0.25, 1.0], 1, "x", "y")]
    found = encode(spark.createDataFrame(rows, SCHEMA + ", x string, code string")).orderBy("vec_id").collect()
    assert [r.error for r in found] == [0, 0] and found[0].code != found[1].code
    assert encode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert encode(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_sums_are_what_tasks_return(spark):
    """One row an entry and part from each task, however many vectors it has."""
    table = spark.range(3000).selectExpr("id", "transform(sequence(0, 7), i -> cast(pmod(hash(id, i), 2000) as bigint)) x")
    books = partial_distance.codebooks(table, entries=16, rounds=1)
    assert [b.shape for b in books] == [(16, 2)] * 4
