"""Spelling variants against a comparison of all words, and their edge cases."""

import random
import re
import zlib
from collections import Counter

from folio.llm import spelling
from folio.llm.spelling import Halves, deletions, differs_once, near_words, variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(docs, damage=spelling.DAMAGE, least=6):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return found


def brute(docs, damage=spelling.DAMAGE, least=6, occurs=5, times=5):
    n = {w: c for w, c in counted(docs, damage, least).items() if c >= occurs}
    near = {w: [o for o in n if differs_once(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def found(spark, docs, **more):
    return sorted(tuple(r) for r in variants(spark.createDataFrame(docs, "doc_id long, text string"), **more).select(*COLUMNS).collect())


def test_differs_once():
    def slow(a, b):
        letters = set(a + b)
        ways = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in letters for k in (0, 1)}
        return a != b and b in ways

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6))) for _ in "xy")
        assert differs_once(a, b) == slow(a, b), (a, b)


def test_deletions_by_hash_are_those_by_string(monkeypatch):
    words = ["".join(random.Random(i).choices("abc", k=6)) for i in range(60)]
    plain = [deletions(w) for w in words]
    monkeypatch.setattr(spelling, "SHORT", 3)
    hashed = [deletions(w) for w in words]
    for i in range(60):
        for j in range(60):
            assert bool(plain[i] & plain[j]) == bool(hashed[i] & hashed[j])


def test_against_all_words(spark):
    rng, docs = random.Random(2), []
    stems = ["".join(rng.choices("abcdeé", k=rng.randrange(5, 11))) for _ in range(60)]
    for i in range(80):
        words = []
        for _ in range(60):
            w = list(stems[min(int(rng.expovariate(0.08)), 59)])
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choices("abÉ", k=rng.randrange(2))
            words.append("".join(w).capitalize() if rng.random() < 0.2 else "".join(w))
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    want = brute(docs, damage=7, occurs=2, times=2)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert found(spark, docs, damage=7, occurs=2, times=2) == want
    assert found(spark, docs, damage=7, occurs=2, times=2, shard=20) == want  # most leads are split


def test_hot_halves_are_looked_up(spark, monkeypatch):
    """Words that share a half are compared with few others, and all near ones are found."""
    words = sorted({"common" + "".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(2500)})
    halves, compared = Halves([(0, w, 1) for w in words]), []
    monkeypatch.setattr(spelling, "differs_once", lambda a, b: compared.append(1) or differs_once(a, b))
    n_near = {w: halves.near(w)[0] for w in words}
    assert len(compared) < 40 * len(words)
    some = words[::50]
    assert [n_near[w] for w in some] == [sum(differs_once(w, o) for o in words) for w in some]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    split = {r.word: r.n_near for r in near_words(table, shard=300).collect()}
    assert split == {w: c for w, c in n_near.items() if c}


def test_edges(spark):
    long = "x" * 3000
    docs = [(None, "wordone " * 5), (1, None), (2, ""), (3, "wordtwo " * 25), (3, "wordtwo " * 25), (4, "wordtwoo " * 5 + "short " * 9), (5, f"{long} " * 30), (6, f"{long}y " * 6), (7, "ABCDEFŸ abcdef " * 5)]
    assert found(spark, docs) == brute(docs)
    assert found(spark, docs[1:3]) == []
    table = spark.createDataFrame([(1, "wordone " * 5, "a", "b", 2)], "doc_id long, text string, word string, run string, n int")
    assert [tuple(r) for r in variants(table).select(*COLUMNS).collect()] == [("wordone", None, "wordone", 5, 0, None)]
    assert variants(table.limit(0)).count() == 0
