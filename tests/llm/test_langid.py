import math
import zlib
from collections import Counter, defaultdict

from folio.llm.langid import fit, predict, words_of
from folio.llm.queries import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    rows = predict(docs, fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = [(i, t, la, "s") for i in range(30) for t, la in (("the cat and the dog", "en"), ("der Hund und die Katze", "de"))]
    df = spark.createDataFrame([*train, (99, None, "en", None), (98, "12 !!", None, "x"), (97, "", "de", "x"), (None, "und die " * 30000, None, "s"), (96, "thecat", "de", "s"), (96, "ж" * 1000, "de", "s")], "doc_id long, text string, lang string, score string")
    model = fit(df)
    got = [(r.doc_id, r.lang_pred) for r in predict(df, model).where("doc_id >= 96 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(99, "und"), (98, "und"), (97, "und"), (None, "de"), (96, "en"), (96, "de")], key=str)
    none = df.limit(0)
    assert predict(none, fit(none)).collect() == []
    assert [r.lang_pred for r in predict(df.limit(1), fit(none)).collect()] == ["und"]


def test_numerals_are_no_letters():
    assert words_of("½ ² Ⅷ 12 _") == [] and words_of(None) == []
    assert words_of("x² Été½ab d'or") == ["x", "été", "ab", "d", "or"]


def plain(train):
    """Scores by language straight from the definition: known words first, then ever shorter n-grams."""
    counts = defaultdict(Counter)
    for lang, text in train:
        for w in words_of(text):
            counts[lang, 0][w] += 1
            for n in range(1, 6):
                counts[lang, n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    kept = {k: {g: c for g, c in found.items() if c > 1 or 0 < k[1] < 3} for k, found in counts.items()}
    total = {k: sum(found.values()) for k, found in kept.items()}
    langs = sorted({la for la, _ in train})

    def unit(lang, n, g):
        c = kept[lang, n].get(g)
        return min(8.0, -math.log10(c / total[lang, n])) if c else 8.0

    def word(w):
        if any(w in kept[la, 0] for la in langs):
            return [unit(la, 0, w) for la in langs]
        for n in range(5, 0, -1):
            padded = f" {w} " if n > 1 else w
            known = [g for i in range(len(padded) - n + 1) if any((g := padded[i : i + n]) in kept[la, n] for la in langs)]
            if known:
                return [sum(unit(la, n, g) for g in known) / len(known) for la in langs]
        return [8.0] * len(langs)

    def predict(text):
        words = words_of(text)
        if not words:
            return "und", 0.0
        mean = [sum(s) / len(words) for s in zip(*map(word, words), strict=True)]
        odds = [math.exp((min(mean) - m) * math.log(10) * min(len(words), 50)) for m in mean]
        return langs[mean.index(min(mean))], max(odds) / sum(odds)

    return predict


def test_matches_brute_force(spark):
    train = [("en", "the cat and the dog and a thing"), ("en", "that other thing there"), ("de", "der Hund und die Katze und das Ding"), ("de", "über den Dächern der Stadt"), ("ru", "кот и собака и кот"), ("ru", "собака там")]
    probes = ["the thing", "Katzen und Dinge", "собаки там", "dogthing über", "zzz", "кот the", "½ 12", None, "", "q", "andere andere other"]
    free = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, t, la) for k, (la, t) in zip(free, train)] + [(next(k for k in range(60) if k not in free), "the the der", "en")] + [(100 + k, t, None) for k, t in enumerate(probes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = [(la, t) for k, t, la in rows if la and zlib.crc32(str(k).encode()) % 3 != 1]
    want, got = plain(known), {r.doc_id: (r.lang_pred, r.score) for r in predict(df, fit(df)).collect()}
    assert len({la for la, _ in known}) == 3
    for k, text, _ in rows:
        lang, score = want(text)
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-9, text
