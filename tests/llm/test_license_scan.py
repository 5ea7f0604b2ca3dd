"""License scans against every span of every text, and their edge cases."""

import random
import re

import pytest

from folio.llm import license_scan
from folio.llm.license_scan import NOTICES, PHRASES, TEMPLATES, template

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def base(text):
    w = words(text)
    at = [(i, t.label) for t in PHRASES for i in range(len(w)) if tuple(w[i : i + len(t.words)]) == t.words]
    return len(w), len(at), min(at, default=[None])[0], max(at, default=[None])[0], ",".join(sorted({x for _, x in at}))


def notices(text):
    """Labels whose template some span of the text is near enough to."""
    w, found = words(text), set()
    for t in NOTICES:
        m = len(t.words)
        for i in range(len(w)):
            for n in range(m - t.allowed, m + t.allowed + 1):
                span = w[i : i + n]
                if i + n <= len(w) and set(t.must) <= set(span) and edits(t.words, span) <= t.allowed:
                    found.add(t.label)
    return found


def scanned(spark, rows, **more):
    return [r.asDict() for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), **more).select(*COLUMNS).collect()]


def test_against_every_span(spark):
    rng, rows = random.Random(5), []
    filler = "red blue of the under version 2 free all rights license cc by general public".split()
    for i in range(60):
        w = rng.choices(filler, k=rng.randrange(0, 30))
        for t in rng.sample(TEMPLATES, rng.randrange(0, 3)):
            own = list(t.words)
            for _ in range(rng.randrange(0, t.allowed + 2)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["odd"], [own[at], "odd"]])
                own = own or ["odd"]
            w += own + rng.choices(filler, k=12)
        rows.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    for r in scanned(spark, rows):
        text = rows[r["doc_id"]][1]
        n, count, first, last, labels = base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, count, first, last, labels)
        assert set(filter(None, r["labels"].split(","))) == notices(text) | set(filter(None, labels.split(","))), text


def test_edges(spark):
    notice = "Released under the MIT License"
    rows = [(1, None), (2, ""), (None, notice), (3, notice), (3, notice), (4, "CC-BY cc by, by"), (5, "cc " * 5000 + "by"), (6, "Released under the Blue License"), (7, "cc by")]
    by = {}
    for r in scanned(spark, rows):
        by.setdefault(r["doc_id"], []).append(r)
    nothing = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    assert by[1] == [{"doc_id": 1, "n_words": 0} | nothing] and by[2] == [{"doc_id": 2, "n_words": 0} | nothing]
    assert [r["labels"] for r in by[None] + by[3]] == ["mit"] * 3 and by[3][0] == by[3][1] and by[3][0]["score"] == 1
    assert [(r["n_base"], r["first_word"], r["last_word"]) for r in by[4] + by[5] + by[7]] == [(2, 0, 2), (1, 4999, 4999), (1, 0, 0)]
    assert by[6][0]["labels"] == ""


def test_words_may_differ_but_versions_must_not(spark):
    text = "Licensed under {} Apache License, Version {}"
    found = scanned(spark, [(1, text.format("this", "2.0")), (2, text.format("the", "1.0")), (3, text.format("the very", "2.0"))])
    assert {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in found} == {1: ("apache-2.0", 0.875), 2: ("", 0.0), 3: ("apache-2.0", 0.875)}


def test_empty_tables_extra_columns_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 2, "y")], "doc_id long, text string, w string, k1 int, places string")
    assert license_scan.scan(docs, [template("abc", "a b c", phrase=True)]).select("labels", "n_base").collect() == [("abc", 1)]
    kept = license_scan.spans(docs.drop("w", "k1", "places").withColumnRenamed("text", "body"), [template("ab", "a b")], "body").collect()[0]
    assert kept.body == "a b c" and [(x.label, x.at) for x in kept.found] == [("ab", 0)]
    assert license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, [template("one", "a")])
