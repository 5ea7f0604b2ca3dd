import numpy as np
import pytest

from folio.llm.hilbert_ann import hilbert, search
from folio.llm.queries import read_table


def exact(rows, every, k):
    seen = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in seen:
        if q % every == 0:
            s = sorted((-float(np.add.reduce(seen[q] * v)), i) for i, v in seen.items() if i != q)[:k]
            out[q] = [i for _, i in s]
    return out


def test_hilbert_neighbours_are_one_step_apart():
    import folio.llm.hilbert_ann as h

    side = 1 << 4
    grid = np.array([(x, y) for x in range(side) for y in range(side)]) << (h.ORDER - 4)
    walk = grid[np.argsort(hilbert(grid))] >> (h.ORDER - 4)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_recall(spark, spread):
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 24))
    rows = [(i, (centres[i % 40] + spread * r.standard_normal(24)).tolist()) for i in range(4000)]
    got = {}
    for x in search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.vec_id
    rows = [(i, np.array(v, np.float32)) for i, v in rows]
    want = exact(rows, 20, 20)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert np.mean([len(set(got[q].values()) & set(want[q])) / 20 for q in want]) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(60, [2.0, 1.0]), (61, None), (62, [0.0, 0.0]), (63, [1.0, None]), (64, [float("nan"), 1.0]), (65, [float("inf"), 1.0]), (None, [1.0, 1.0]), (66, [1.0]), (0, [1.0, 2.0]), (80, [1.0, 2.0])]
    got = {}
    for x in search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    want = exact([(i, v) for i, v in rows if i is not None and (i <= 60 or i == 80)], 20, 20)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == want
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
