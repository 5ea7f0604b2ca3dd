import random
import re

import pytest
import xxhash

from folio.llm.simhash_dedup import components, fingerprint, links, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_documents_match_brute_force(spark):
    r = random.Random(3)
    make = lambda n: " ".join(r.choice("The of AND Être x to it was né".split(" ")) + str(r.randrange(9)) for _ in range(n))
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ONE TWO"), (6, make(3000))]
    for i in range(7, 200):
        if r.random() < 0.5:
            docs.append((i, make(r.randrange(1, 300))))
        else:
            t = (r.choice(docs)[1] or "p q r s").split(" ")
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = "edit"
            docs.append((i, " ".join(t)))
    fps = {i: plain(t) for i, t in docs}
    df = spark.createDataFrame([*docs, docs[9], (None, "x")], "doc_id long, text string").repartition(3)
    rows = near_duplicates(df).collect()
    assert len(rows) == len(docs) + 2
    assert {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == groups(fps)
    assert [r.fingerprint for r in rows if r.doc_id is None] == [f"{plain('x'):016x}"]


def test_null_and_repeated_ids(spark):
    docs = [(None, "a text of its own"), (None, "a text of its own"), (None, "copied words stay"), (7, "copied words stay"), (7, "another thing"), (4, "another thing")]
    rows = near_duplicates(spark.createDataFrame([(*d, "f") for d in docs], "doc_id long, text string, fingerprint string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("7", "4"), ("7", "7"), ("None", "7"), ("None", "None"), ("None", "None")]


@pytest.mark.parametrize("bucket", [32, 2])
def test_links_keep_every_component(spark, monkeypatch, bucket):
    import folio.llm.simhash_dedup as s

    monkeypatch.setattr(s, "BUCKET", bucket)
    r = random.Random(bucket)
    centres = [r.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}) for c in centres for _ in range(25)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    edges = links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {x.node: x.root for x in components(edges).collect()}
    want = groups({f: f & (1 << 64) - 1 for f in signed})
    assert {f: got.get(f, f) for f in signed} == want


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fingerprint(b"") == 0
