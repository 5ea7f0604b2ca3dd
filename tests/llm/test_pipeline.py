"""Each stage of the pipeline against brute force, and on rows that are odd."""

import random
import re

import corpus_pipeline as c
from folio.llm.common import materialize
from test_decontaminate import brute as decontaminated
from test_mixing import plain as mixed
from test_shingle_dedup import groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = SCHEMA + ", id string, t string, h string, w array<string>, keep boolean"


def table(spark, rows, odd=False):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame([(*r, "x", "y", "z", ["q"], False) if odd else r for r in full], ODD if odd else SCHEMA).repartition(3)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and to in was it that for as".split()) + r.choice("abcdefgh") for _ in range(n))


def test_language_keeps_texts_with_letters(spark):
    rows = [(k, f"the cat and the dog number {k}", "a") for k in range(40)] + [(100, None, "a"), (101, "", "a"), (102, "12 ½ ?", None), (None, "the dog", None), (5, "the cat and the dog number 5", "a"), (103, "the dog " * 50_000, "b")]
    got = c.language(spark, table(spark, rows, odd=True), "")
    assert got.columns == list(c.COLUMNS)
    want = [(i, t) for i, t, _ in rows if re.search("[a-z]", t or "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert c.language(spark, table(spark, []), "").collect() == []


def test_near_duplicates_match_brute_force(spark):
    base = words(1, 150).split()
    edit = lambda n, seed: " ".join("new" + str(seed) if k % (150 // n) == 3 else w for k, w in enumerate(base)) if n else " ".join(base)
    docs = [(k, edit(k % 5, k), "s") for k in range(12)] + [(20, words(2, 40), "s"), (21, None, "s"), (22, "", "s"), (23, "two words", "s")]
    want = groups([(i, t) for i, t, _ in docs])
    rows = [*docs, (20, words(2, 40), "s"), (None, edit(0, 0), "s"), (None, words(3, 30), "s"), (None, words(3, 30), "s")]
    got = c.near_duplicates(spark, table(spark, rows, odd=True), "")
    assert got.columns == list(c.COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(i, t) for i, t, _ in docs if want[i] == i] + [(None, words(3, 30))] * 2, key=str)
    assert c.near_duplicates(spark, table(spark, []), "").collect() == []


def cut(docs):
    """Bytes of each document that no string of 100 starting earlier covers."""
    seen, out = set(), {}
    for i, t in docs:
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 99):
            if (s := data[k : k + 100]) in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(s)
        out[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def test_repeats_match_brute_force(spark):
    passage = words(5, 60)
    docs = [(1, words(6, 30) + passage + words(7, 30), "s"), (2, None, None), (3, "", "s"), (4, passage, "s"), (5, "short", "s"), (6, words(8, 20) + passage, None), (7, words(9, 4000) + passage * 3, "s")]
    left = cut([(i, t) for i, t, _ in docs])
    got = c.repeats(spark, table(spark, [*docs, (5, "short", "s"), (None, words(10, 50), "s")], odd=True), "")
    assert got.columns == list(c.COLUMNS)
    rows = {(r.doc_id, r.text, r.source) for r in got.collect()}
    assert rows == {(i, None if t is None else left[i].decode(), s) for i, t, s in docs if not t or left[i]} | {(None, words(10, 50), "s")}
    assert got.count() == 8 and c.repeats(spark, table(spark, []), "").collect() == []


def test_benchmark_passages_match_brute_force(spark, tmp_path):
    items = [(1, words(11, 30)), (2, "rare short item"), (None, words(12, 20)), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, words(13, 40), "s"), (2, words(13, 20) + " " + " ".join(items[0][1].split()[3:15]) + " x", "s"), (3, "a RARE, short item!", "s"), (4, None, "s"), (5, "", None), (6, " ".join(items[0][1].split()[:9]), "s"), (7, items[2][1], "s")]
    hit = decontaminated([(i, t) for i, t, _ in docs], items)
    rows = [*docs, (None, docs[1][1], "s"), (None, "clean", "s"), (1, items[0][1], "s"), (7, items[2][1], "s")]
    got = c.benchmark_passages(spark, table(spark, rows, odd=True), str(tmp_path))
    assert got.columns == list(c.COLUMNS)
    want = [(i, t) for i, t, _ in docs if not hit[i][4]] + [(None, "clean")]  # words of an item without an id count too
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert c.benchmark_passages(spark, table(spark, []), str(tmp_path)).collect() == []


def test_mixture_matches_brute_force(spark):
    r = random.Random(4)
    docs = [(k, "w " * r.choice([3, 40, 41, 200]), r.choice("aab")) for k in range(300)]
    got = c.mixture(spark, table(spark, docs, odd=True), "").collect()
    want = mixed([(i, len(t.split()), s) for i, t, s in docs], {x.source: x.target for x in got})
    assert {x.doc_id: x.taken for x in got} == want
    assert c.mixture(spark, table(spark, []), "").collect() == []


def test_run_applies_every_stage_and_leaves_no_folders(spark, tmp_path, monkeypatch):
    import folio.llm.common as common

    sf, base = str(tmp_path), spark.conf.get("spark.checkpoint.dir")
    rows = [(k, words(100 + k, 30 + k), "ab"[k % 2]) for k in range(60)] + [(60, words(100, 30), "a"), (61, None, "b"), (62, "99", "a"), (63, words(101, 31) + " " + words(200, 40), "b")]
    table(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, words(200, 40))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    made, removed = [], []
    make, gone = common.work_dir, common.delete
    monkeypatch.setattr(common, "work_dir", lambda s: made.append(make(s)) or made[-1])
    monkeypatch.setattr(common, "delete", lambda s, path: removed.append(path.rsplit("/", 1)[-1]) or gone(s, path))
    out = c.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(range(60)) and base
    for k in range(5):  # what comes in again, by hand
        docs = c.STAGES[k][1](spark, docs if k else spark.read.parquet(f"{sf}/documents.parquet"), sf)
        docs = materialize(docs)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, out))
    before_last = [p.rsplit("/", 1)[-1] for p in made]
    assert len(removed) > 10 and set(removed) <= set(before_last)
