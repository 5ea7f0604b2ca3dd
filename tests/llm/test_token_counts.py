import random

from folio.llm.token_counts import PATTERN, VOCABULARY, Vocabulary, token_counts

VOCAB = Vocabulary(open(VOCABULARY).read().splitlines())


def test_trie_matches_plain_recurrence():
    r = random.Random(2)
    tokens = {"".join(r.choices("abcdeéß ñth", k=r.randrange(1, 20))).encode() for _ in range(3000)} | {b"a", b"ab", b"abc", b"the", b" the", bytes(range(1, 40))}
    tokens = sorted(t for t in tokens if len(t) <= 48)
    assert VOCAB.counts(tokens).tolist() == [VOCAB.plain(t) for t in tokens]
    assert VOCAB.plain(b" the") == 1


def test_documents(spark):
    texts = [None, "", "Hello  world!\n\n 123", "ünï" * 5000, "a\0b", "the of and", "the of and", " " * 100]
    df = spark.createDataFrame([(i if i != 5 else None, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(2)
    got = sorted(map(tuple, token_counts(df).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        cut = PATTERN.findall(t or "")
        assert "".join(cut) == (t or "")
        want.append((i if i != 5 else None, len(cut), sum(VOCAB.plain(c.encode()) for c in cut)))
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0)).collect() == []


def test_longest_pieces(spark):
    def uncapped(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            s, n = max(((best[at][0] + VOCAB.score[token[at:end]], -best[at][1] - 1) for at in range(end) if token[at:end] in VOCAB.score), default=(float("-inf"), 0))
            best.append((s, -n))
        return best[-1][1]

    rules = [(" " * space + sign * n).encode() for sign in "-=._" for n in (47, 48, 49, 56, 63, 64, 65, 128, 200) for space in (0, 1)]
    rules += [p for p in VOCAB.score if len(p) > 48]
    assert [VOCAB.plain(t) for t in rules] == [uncapped(t) for t in rules]
    df = spark.createDataFrame([(1, "-" * 64), (2, "a\n" + "-" * 128)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {1: 1, 2: 2 + uncapped(b"-" * 128)}


def test_a_pretoken_without_a_break_takes_time_in_proportion():
    import time

    r = random.Random(4)
    long = "".join(r.choices("abcdeéß", k=300_000)).encode()
    began = time.time()
    assert VOCAB.plain(long) > 100_000
    assert time.time() - began < 20  # a slice for each byte and length took minutes
    assert VOCAB.plain(b"") == 0
