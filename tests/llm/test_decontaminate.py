import hashlib
import random
import re

from folio.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        if w:
            n = min(len(w), 10)
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = {}
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_matches_brute_force(spark):
    r = random.Random(4)
    make = lambda n: " ".join(r.choice(["alpha", "Beta", "GAMMA-delta", "né", "Été", "x1", "über", "o"]) + r.choice("abcdefghij") for _ in range(n))
    items = [(i, make(r.randrange(12, 60))) for i in range(12)] + [(12, None), (13, " .. "), (14, "rare shortitem here"), (15, "single9"), (None, make(20)), (17, make(10))]
    items += [(18, items[0][1]), (100, items[3][1].upper())]
    docs = [(0, None), (1, ""), (2, "ok"), (3, items[1][1]), (4, make(4000) + " " + items[2][1] + " " + make(3000)), (5, "single9 Rare, shortITEM; here. single9")]
    for i in range(6, 80):
        w = split(r.choice(items)[1] or "a b c d")
        a = r.randrange(len(w) + 1)
        docs.append((i, make(r.randrange(30)) + " " + " ".join(w[a : a + r.randrange(25)]) + " " + make(r.randrange(30))))
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, w string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows(contamination(d, b))
    want = brute(docs, items)
    assert got == want
    assert sum(x[4] for x in want.values()) > 10


def test_empty_tables_and_repeats(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(contamination(d, none)) == brute([(1, "a b"), (2, None)], [])
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(d.limit(0), one).collect() == []
    assert [r.n_hit for r in contamination(d.where("doc_id = 1").union(d.where("doc_id = 1")), one).collect()] in ([2], [2, 2])


def test_ids_that_repeat(spark):
    one = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    items = spark.createDataFrame([(7, "a b"), (7, "c d"), (8, "c d"), (9, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b z z e"), (1, "a b z z e"), (None, "x y"), (None, None), (2, "q r s t u")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in contamination(docs, items).collect()), key=str)
    want = [(1, 5, 4, 2, one("7", "8")), (1, 5, 2, 1, one("7")), (1, 5, 2, 1, one("7")), (None, 2, 1, 1, one("9")), (None, 0, 0, 0, one("")), (2, 5, 0, 0, one(""))]
    assert got == sorted(want, key=str)


def test_words_of_an_item_without_an_id_are_hit(spark):
    items = spark.createDataFrame([(None, "p q"), (1, "a b"), (None, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x p q"), (2, "a b p q")], "doc_id long, text string")
    got = rows(contamination(docs, items))
    assert got[1] == (3, 2, 0, hashlib.sha256(b"").hexdigest(), True)
    assert got[2] == (4, 4, 1, hashlib.sha256(b"1").hexdigest(), True)
