"""Free names against a loop over all events."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import naming
from folio.operators.naming import RELEASE, REQUEST, USED, give_names
from folio.operators.registry import allocate_names


def loop(events):
    taken, out = {n for _, step, n in events if step == USED}, {}
    for seq, step, name in sorted(e for e in events if e[1] != USED):
        if step == RELEASE:
            taken.discard(name)
        else:
            free, k = name, 2
            while free in taken:
                free, k = f"{name}_{k}", k + 1
            taken.add(free)
            out[seq] = (name, free)
    return out


def given(spark, events):
    rows = give_names(spark.createDataFrame(events, "seq long, step int, name string").repartition(3)).collect()
    assert len(rows) == len({r.seq for r in rows})
    return {r.seq: (r.slug, r.name) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_are_those_of_a_loop(spark, seed):
    r = random.Random(seed)
    slugs = ["a", "b", "c_d", "e", "f"] + (["a_2", "b_3", "b_2_2", "a_02"] if seed > 1 else [])
    events = [(-1, USED, r.choice(slugs) + r.choice(["", "_2", "_3", "_5", "_02", "_7_2", "_10"])) for _ in range(25)]
    for seq in range(0, 300):
        if seed == 3 and r.random() < 0.4:
            events.append((seq, RELEASE, r.choice(slugs[:4]) + r.choice(["", "_2", "_4", "_6"])))
        events.append((seq, REQUEST, r.choice(slugs)))
    assert given(spark, events) == loop(events)


def test_large_families_are_ranked_in_slices(spark):
    """Taken numbers with gaps, and requests far apart in order."""
    events = [(-1, USED, "x")] + [(-1, USED, f"x_{k}") for k in range(2, 400) if k % 3] + [(seq * 1_000_003, REQUEST, "x") for seq in range(700)]
    assert given(spark, events) == loop(events)


def test_only_contested_families_are_folded(spark, monkeypatch):
    monkeypatch.setattr(naming, "_fold", lambda batches: 1 / 0)
    events = [(-1, USED, "a"), (1, REQUEST, "a"), (2, REQUEST, "b"), (3, RELEASE, "nobody_asks")]
    assert given(spark, events) == {1: ("a", "a_2"), 2: ("b", "b")}


def test_many_releases_do_not_start_over(spark):
    """40,000 numbers of one slug, each released and asked for again: numbers are looked for from the released one on."""
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.explode(F.array(F.struct(F.lit(RELEASE).alias("step"), F.concat(F.lit("s_"), F.col("id") + 2).alias("name")), F.struct(F.lit(REQUEST).alias("step"), F.lit("s").alias("name")))).alias("x")).select("seq", "x.step", "x.name")
    used = spark.range(n + 2).select(F.lit(-1).cast("long").alias("seq"), F.lit(USED).alias("step"), F.when(F.col("id") == 0, "s").otherwise(F.concat(F.lit("s_"), F.col("id") + 1)).alias("name"))
    got = give_names(used.unionByName(rows))
    assert got.where(F.col("name") != F.concat(F.lit("s_"), F.col("seq") + 2)).count() == 0 and got.count() == n


def test_empty_and_used_rows(spark):
    schema = "seq long, slug string, used boolean"
    assert allocate_names(spark.createDataFrame([], schema)).collect() == []
    rows = allocate_names(spark.createDataFrame([(-1, "a", True), (-1, "a", True), (5, "a", False), (2, "a", False)], schema)).collect()
    assert sorted(tuple(r) for r in rows) == [(-1, "a", True, "a"), (-1, "a", True, "a"), (2, "a", False, "a_2"), (5, "a", False, "a_3")]
