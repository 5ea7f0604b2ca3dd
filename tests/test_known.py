"""Known keys: nothing lost, nothing kept twice, and little read."""

import random

import pytest

from pyspark.sql import functions as F

from folio.streaming.incremental import run_batches
from folio.streaming.known import Known

SCHEMA = "seq long, a string, b int"


def keys_of(df):
    return sorted((r.a, r.b) for r in df.collect())


@pytest.mark.parametrize(("words", "buckets"), [(1 << 12, 16), (4, 3)])
def test_no_duplicate_is_lost(spark, tmp_path, words, buckets):
    """Also with a filter so small that it's full."""
    r, known, seen = random.Random(words), Known(spark, str(tmp_path / "known"), words, buckets), set()
    for number in range(5):
        rows = [(k, r.choice("abcdefgh") * r.randrange(1, 9), r.choice([1, 2, 3, None])) for k in range(60)]
        batch = spark.createDataFrame(rows, SCHEMA)
        got = known.unseen(batch, ["a", "b"], number)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in rows if x[1:] not in seen)
        known.add(got, ["a", "b"], number)
        seen |= {x[1:] for x in rows if x[2] is not None}


def test_a_batch_that_runs_again_does_not_see_itself(spark, tmp_path):
    known = Known(spark, str(tmp_path / "known"), 64, 4)
    first, second = spark.createDataFrame([(1, "x", 1)], SCHEMA), spark.createDataFrame([(2, "y", 1), (3, "x", 1)], SCHEMA)
    known.add(first, ["a", "b"], 0)
    for _ in range(2):
        new = known.unseen(second, ["a", "b"], 1)
        assert keys_of(new) == [("y", 1)]
        known.add(new, ["a", "b"], 1)
    assert keys_of(known.unseen(second, ["a", "b"], 2)) == []


def test_bytes_read_do_not_grow_with_the_history(spark, tmp_path, monkeypatch):
    """A batch of new keys opens the filter, whose size stands, and the few buckets of its false hits."""
    known, opened = Known(spark, str(tmp_path / "known"), 1 << 14, 64), []
    batch = lambda k: spark.range(k * 300, k * 300 + 300).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("a"), F.lit(1).alias("b"))
    for k in range(8):
        new = known.unseen(batch(k), ["a", "b"], k)
        files = [f for f in new.inputFiles() if "/keys/" in f]
        opened.append(len({f.split("bucket=")[1].split("/")[0] for f in files}))
        assert new.count() == 300
        known.add(new, ["a", "b"], k)
    stored = {p.parent.name for p in (tmp_path / "known/keys").glob("bucket=*/batch=*")}
    assert len(stored) == 64 and opened[0] == 0 and max(opened) <= 4
    filters = sorted((tmp_path / "known/filter").iterdir())
    assert len(filters) == 3
    size = [sum(f.stat().st_size for f in p.glob("*.parquet")) for p in filters]
    assert max(size) <= (1 << 14) * 16 + 20_000
    again = known.unseen(batch(2).limit(1), ["a", "b"], 8)
    assert again.count() == 0


def test_a_stream_that_restarts_brings_each_key_once(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "a", 1), (3, None, 1)], [(4, "a", 1), (5, "b", 1), (6, None, 1)], [(7, "b", 1), (8, "c", 1)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)
        run_batches(spark.readStream.schema(SCHEMA).parquet(land), lambda b: b, out, str(tmp_path / "ck"), ["a", "b"]).awaitTermination()
    assert sorted(str(r.a) for r in spark.read.parquet(out).collect()) == ["None", "None", "a", "b", "c"]
