import random
import re

import pytest

import corpus_pipeline
from folio.llm.shingle_dedup import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(docs):
    """The least id of each document's component, over all pairs."""
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    for i in sets:
        for j in sets:
            if j < i and any(x == y or 5 * len(x & y) >= 4 * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def corpus(n, seed):
    """Documents, edited copies with similarities around 0.8, and chains of edits."""
    r = random.Random(seed)
    make = lambda k: [r.choice("The of AND Être x to it was né".split(" ")) + str(r.randrange(9)) for _ in range(k)]
    line, docs = make(12), [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ONE TWO")]
    for i in range(6, n):
        kind = r.random()
        if kind < 0.3:
            words = make(r.randrange(1, 150)) + line
        elif kind < 0.5:
            words = list(base)
            words[r.randrange(len(words))] = f"edit{i}"
        else:
            words = (r.choice(docs)[1] or "p q r s t").split(" ")
            for _ in range(r.randrange(6)):
                words[r.randrange(len(words))] = f"edit{r.randrange(9)}"
        if i == 6:
            words = make(60)
        if i == 6 or r.random() < 0.02:
            base = words
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize(("bucket", "rounds"), [(32, 4), (3, 1), (3, 0)])
def test_documents_match_brute_force(spark, monkeypatch, bucket, rounds):
    import folio.llm.shingle_dedup as s

    monkeypatch.setattr(s, "BUCKET", bucket)
    monkeypatch.setattr(s, "ROUNDS", rounds)
    docs = corpus(260, bucket + rounds)
    df = spark.createDataFrame([*docs, docs[9], (None, "x")], "doc_id long, text string").repartition(3)
    rows = near_duplicates(df).collect()
    want = groups(docs)
    assert len(rows) == len(docs) + 2
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert 30 < len(set(want.values())) < 200


def test_stage_keeps_one_of_edited_copies(spark):
    words = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    docs = [(1, edited()), (2, edited(20, 60, 120)), (3, edited(0, 30, 50, 70, 90, 110)), (4, "other text of more than five words"), (5, edited(*range(0, 200, 9)))]
    table = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    want = groups(docs)
    assert want == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(None, words), (None, words), (None, "copied words stay"), (7, "copied words stay"), (7, words + " end"), (9, "alone")]
    rows = near_duplicates(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, t int")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("7", "7"), ("7", "7"), ("9", "9"), ("None", "7"), ("None", "7"), ("None", "7")]


def compared(monkeypatch):
    """Collects the pairs that meet, before any is left out."""
    import folio.llm.shingle_dedup as s

    seen, paired = [], s._paired

    def count(*args):
        pairs = paired(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(s, "_paired", count)
    return seen


def test_boilerplate_gives_far_fewer_than_all_pairs(spark, monkeypatch):
    """5,000 texts of one boilerplate, no two similar enough: 100 words in common and 20 to 40 of their own."""
    seen = compared(monkeypatch)
    r = random.Random(1)
    common = " ".join(f"c{i}" for i in range(100))
    docs = [(i, " ".join(f"own{i}x{k}" for k in range(r.randrange(20, 41))) + " " + common) for i in range(5000)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert all(x.doc_id == x.component_id for x in rows) and len(rows) == 5000
    assert sum(seen) < 50_000, seen


def test_large_groups_are_linked_without_all_pairs(spark, monkeypatch):
    """Two groups of near copies around one boilerplate, and texts that have it and are like neither."""
    seen = compared(monkeypatch)
    common = [f"c{i}" for i in range(100)]
    docs = []
    for i in range(1500):
        group, own = i % 2, f"e{i}"
        docs.append((i, " ".join([f"g{group}w{k}" for k in range(30)] + common[: i % 97] + [own] + common[i % 97 :])))
    docs += [(2000 + i, " ".join([f"o{i}x{k}" for k in range(25)] + common)) for i in range(500)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in rows} == {i: i % 2 if i < 2000 else i for i, _ in docs}
    assert sum(seen) < 200_000, seen


def test_sets_beside_a_large_group_are_not_compared_with_all_of_it(spark, monkeypatch):
    """400 copies of one text with an edit each, and 120 that lack 16 of its shingles; of those copies these are only like the ones that lack nothing else."""
    seen = compared(monkeypatch)
    r, base = random.Random(2), [f"c{i}" for i in range(150)]

    def edited(i, *at):
        return " ".join(f"e{i}x{k}" if k in at else word for k, word in enumerate(base))

    docs = [(i, edited(i, r.randrange(5, 70))) for i in range(400)]
    docs += [(400 + i, edited(400 + i, k := r.randrange(80, 105), k + 1, k + 12, k + 25)) for i in range(120)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in rows} == groups(docs)
    assert sum(seen) < 35_000, seen


def test_fingerprints_link_by_themselves_what_is_within_two_bits(spark, monkeypatch):
    """SimHash and its tables of distances, without any pair from shared shingles: all and only the pairs of long texts within two bits that are similar enough."""
    import folio.llm.shingle_dedup as s

    r, docs, paired = random.Random(5), [], s._paired
    for g in range(12):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(600)]
        docs += [(10 * g + i, " ".join([*base[:300], *[f"e{g}x{i}"] * (i > 0), *base[300:]])) for i in range(4)]
        docs.append((10 * g + 4, " ".join(w if k % 60 else f"f{g}" for k, w in enumerate(base))))
    fps = {i: s.fingerprint(s.shingles(t.encode())) & (1 << 64) - 1 for i, t in docs}
    root = {i: i for i in fps}
    for j in sorted(fps):
        for i in [i for i in fps if i < j and i // 10 == j // 10 and (fps[i] ^ fps[j]).bit_count() <= 2]:
            root = {k: min(root[i], root[j]) if x in (root[i], root[j]) else x for k, x in root.items()}
    monkeypatch.setattr(s, "_paired", lambda *args: paired(*args).limit(0))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_duplicates(table).collect()} == root
    assert 20 < len(set(root.values())) < 60
    monkeypatch.undo()
    assert {x.doc_id: x.component_id for x in near_duplicates(table).collect()} == groups(docs) == {i: i // 10 * 10 for i, _ in docs}


def test_no_query_joins_many_tables(spark, monkeypatch):
    """The driver holds a query's plan and the tables that it broadcasts, so meetings that are dealt anew may not all end in one query."""
    import folio.llm.shingle_dedup as s
    import folio.llm.simhash_dedup as h

    joins = []

    def counted(df, write=s.materialize):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(s, "materialize", counted)
    monkeypatch.setattr(h, "materialize", counted)
    base = [f"c{i}" for i in range(150)]

    def edited(i, *at):
        return " ".join(f"e{i}x{k}" if k in at else word for k, word in enumerate(base))

    docs = [(i, edited(i, 5 + i % 60)) for i in range(200)] + [(200 + i, edited(200 + i, 80 + i % 25, 85 + i % 25, 95 + i % 25, 110 + i % 25)) for i in range(90)]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.component_id for x in rows} == groups(docs)
    assert max(joins) <= 6, joins
