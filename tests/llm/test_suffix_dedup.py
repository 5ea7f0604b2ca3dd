import hashlib
import random
import re

import pytest

from folio.llm.suffix_dedup import remove_repeats


def brute(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    r = random.Random(seed)
    words = ["the", "of", "ünd", "être", "word", "a", "zz", "ñandú", "passage"]
    make = lambda n: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))
    passages = [make(n) for n in (25, 40, 18, 300)]
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "a" * 450), (5, "b" + "a" * 250), (6, "ab" * 200), (7, make(6000))]
    for i in range(8, 60):
        kind = r.randrange(4)
        if kind == 0:
            docs.append((i, make(r.randrange(5, 80))))
        elif kind == 1:
            docs.append((i, r.choice(docs)[1]))
        elif kind == 2:
            docs.append((i, make(20) + " " + r.choice(passages) + " " + make(20)))
        else:
            t = list(r.choice(docs)[1] or "y" * 200)
            for _ in range(r.randrange(4)):
                if t:
                    t[r.randrange(len(t))] = r.choice("qwé")
            docs.append((i, "".join(t)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = texts(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, a string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == brute(docs)


def test_blocks_of_a_long_text(spark, monkeypatch):
    import folio.llm.suffix_dedup as s

    monkeypatch.setattr(s, "BLOCK", 700)
    docs = texts(3)
    import numpy as np

    ids = sorted(docs)
    data = b"".join((t or "").encode() for _, t in ids)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in ids])])
    doc, off, n, _, _ = s._runs(np.frombuffer(data, np.uint8), offsets)
    windows = {(int(d), int(o) + k) for d, o, m in zip(doc, off, n) for k in range(int(m))}
    assert windows == {(d, p) for d, (_, t) in enumerate(ids) for p in range(len((t or "").encode()) - 99)}
    assert int(n.sum()) == len(windows)


def test_empty_repeated_and_null(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).collect() == []
    text = "".join(random.Random(5).choices("abcdefghij", k=300))
    rows = remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], schema), with_text=True).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in rows), key=str) == [(1, 0), (1, 0), (2, 300), (None, 300)]
    assert {r.kept for r in rows if r.doc_id != 1} == {""}
    first, second = "".join(random.Random(6).choices("abcdef", k=200)), "".join(random.Random(7).choices("abcdef", k=150))
    docs = [(5, first), (5, second), (None, first + second), (None, None), (3, second + "tail"), (None, first + second)]
    rows = remove_repeats(spark.createDataFrame([(*d, "x") for d in docs], schema + ", kept string"), with_text=True, keep=["kept"]).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(3, 154, 0), (5, 200, 0), (5, 150, 150), (None, 350, 350), (None, 350, 350), (None, 0, 0)], key=str)


def test_a_shared_phrase_is_no_one_task(spark, monkeypatch):
    """3,000 texts that share a phrase of 70 bytes and nothing else: its runs are never shuffled to one task."""
    import folio.llm.suffix_dedup as s

    r = random.Random(6)
    phrase = "the phrase that all of these texts have in common, of seventy bytes..."
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    docs = [(i, " ".join([*(word() for _ in range(12)), phrase, *(word() for _ in range(12))])) for i in range(3000)]
    written, write = [], s.materialize
    monkeypatch.setattr(s, "materialize", lambda df: written.append((df, write(df))) or written[-1][1])
    monkeypatch.setattr(s, "discard", lambda *tables: None)
    rows = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert sum(x.n_removed for x in rows) == 0 and len(rows) == 3000
    (_, anchors), (plan, marked) = written
    assert marked.groupBy("a").count().agg({"count": "max"}).first()[0] > 1000  # one anchor has the phrase's runs
    assert anchors.where("kinds").count() < 200
    windows = re.findall(r"windowspecdefinition\((\w+)#\w+, (\w+)#", plan._jdf.queryExecution().optimizedPlan().toString())
    assert windows and set(windows) == {("a", "b")}  # rows meet by anchor and run, which no two texts here share
