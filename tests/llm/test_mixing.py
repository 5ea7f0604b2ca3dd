import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from folio.llm.mixing import mix, targets


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def test_targets_and_taken(spark):
    r = random.Random(9)
    docs = [(i, " ".join(["w"] * r.randrange(1, 200)) if i % 17 else None, r.choice(["a", "b", "ü", "Z", None, "c", "d"])) for i in range(900)]
    docs += [(900 + i, "x\ty\n z" * 100, "hot") for i in range(600)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, size int").repartition(4)
    rows = mix(df).collect()
    sizes = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    assert {x.doc_id: x["size"] for x in rows} == sizes and len(rows) == len(docs)
    by = {}
    for i, _, s in docs:
        by[s] = by.get(s, 0) + sizes[i]
    want = brute_targets(by)
    for x in rows:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == by[x.source]
        assert 0 <= x.taken <= 2 * x["size"]
    for s, t in want.items():
        taken = sum(x.taken for x in rows if x.source == s)
        assert abs(taken - t) <= max(2, 0.003 * t), (s, taken, t)
    again = mix(df.repartition(2)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in rows)


def test_slices_agree_with_one(spark, monkeypatch):
    import folio.llm.mixing as m

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "concat('s', id % 5) as source")
    monkeypatch.setattr(m, "LEAST_SLICES", 1)
    one = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(m, "SLICE_ROWS", 100)
    assert sorted(map(tuple, mix(docs).collect())) == one


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    rows = mix(spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "x", "b"), (3, "p q", "b"), (3, "p q", "b")], schema)).collect()
    assert len(rows) == 5 and sum(r.taken for r in rows if r["size"] == 0) == 0
    assert targets(spark.createDataFrame([("a", 0)], "source string, size long")).first().target == 0


def plain(docs, want, seed=7):
    """taken of each (id, size, source), by ranking each source as a whole."""
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    out = {}
    for source, own in by.items():
        total = sum(d[1] for d in own)
        rate = want[source] / total
        whole, f = int(rate), rate - int(rate)
        step = lambda n: math.floor(math.log2(n + 1) * 8)
        ranked = []
        for i, size, _ in own:
            u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            middle = (sum(d[1] for d in own if step(d[1]) < step(size)) + sum(d[1] for d in own if step(d[1]) == step(size)) / 2) / total
            p = f + f * (1 - f) * (2 * middle - 1)
            q = (u / (1 - u)) / (p / (1 - p)) if p > 0 else math.inf
            ranked.append((q, i, size, p))
        ranked.sort()
        missing, got, extra, k = want[source] - whole * total, 0, set(), 0
        while k < len(ranked) and got + ranked[k][2] <= missing and ranked[k][3] > 0:
            got += ranked[k][2]
            extra.add(ranked[k][1])
            k += 1
        gap = missing - got
        rest = [(abs(x[2] - gap), x[0], x[1]) for x in ranked[k:] if x[3] > 0 and abs(x[2] - gap) < gap]
        extra |= {min(rest)[2]} if rest else set()
        out |= {i: (whole + (i in extra)) * size for i, size, _ in own}
    return out


def test_matches_a_plain_ranking(spark):
    r = random.Random(3)
    docs = [(i, r.choice([1, 2, 5, 30, 31, 300]) + r.randrange(4), r.choice("aaaabbc")) for i in range(700)]
    rows = mix(spark.createDataFrame([(i, "w " * n, s) for i, n, s in docs], "doc_id long, text string, source string").repartition(3)).collect()
    assert {x.doc_id: x.taken for x in rows} == plain(docs, {x.source: x.target for x in rows})


def test_chances_are_unequal_and_kept(spark):
    docs = spark.range(40000).selectExpr("id as doc_id", "repeat('w ', if(id % 2 = 0, 10, 100)) as text", "if(id % 8 < 6, 'a', if(id % 8 = 6, 'b', 'c')) as source")
    rows = [x for x in mix(docs).collect() if x.source == "a"]
    f = rows[0].target / rows[0].source_size % 1
    whole = int(rows[0].target / rows[0].source_size)
    words = {n: sum(x["size"] for x in rows if x["size"] == n) for n in (10, 100)}
    middle = {10: words[10] / 2 / sum(words.values()), 100: (words[10] + words[100] / 2) / sum(words.values())}
    assert 0.05 < f < 0.95
    for n in (10, 100):
        p = f + f * (1 - f) * (2 * middle[n] - 1)
        own = [x.taken / n - whole for x in rows if x["size"] == n]
        assert abs(sum(own) / len(own) - p) < 4 * math.sqrt(p * (1 - p) / len(own)), (n, p)


def test_targets_are_met_where_ids_repeat_or_are_null(spark):
    """Operator and SQL: the last place is one row's, whatever others have its id."""
    import duckdb

    from folio.llm.queries import SQL7

    r = random.Random(12)
    docs = [(r.choice([1, 2, 3, None]), "w " * r.choice([3, 20, 21, 40]), r.choice(["a", "a", "b", "c"])) for _ in range(2500)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).drop("source").collect()
    for target in {x.target for x in rows}:
        assert abs(sum(x.taken for x in rows if x.target == target) - target) <= 40
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    names = ["doc_id", "size", "source_size", "taken"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({SQL7})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(x[n] for n in names)) for x in rows)
