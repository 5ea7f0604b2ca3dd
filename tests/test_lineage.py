"""Moves in order against a loop."""

import random

import pytest

from folio.operators.lineage import UNKNOWN, retarget

PROCESSED, MOVES = "hash string, source string, target string", "seq long, old string, new string, source string"


def left(processed, moves, only=None):
    """Hashes of rows that moves left, or that one move leaves."""
    before = loop(processed, moves[:-1] if only else [])
    now = loop(processed, moves)
    if only:
        hit = any(r[2] == only[1] or r[1] == only[3] for r in before)
        return set() if hit else {UNKNOWN + only[1]}
    return {r[0] for r in now if r[0].startswith(UNKNOWN)}


def loop(processed, moves):
    rows = {h: [s, t] for h, s, t in processed}
    for _, old, new, source in sorted(moves):
        hit = [r for r in rows.values() if r[1] == old or r[0] == source]
        for r in hit:
            r[:] = [source, new]
        if not hit:
            rows[UNKNOWN + old] = [source, new]
    return sorted((h, *r) for h, r in rows.items())


def result(spark, processed, moves):
    return sorted(tuple(r) for r in retarget(spark.createDataFrame(processed, PROCESSED), spark.createDataFrame(moves, MOVES)).collect())


def test_chains_cycles_and_repeats(spark):
    processed = [("h1", "s1", "a"), ("h2", "s2", "p"), ("h3", "s3", "z"), ("h4", "s1", "q")]
    chain = [(1, "a", "b", "x"), (2, "b", "c", "y")]
    assert ("h1", "y", "c") in result(spark, processed, chain)
    cycle = [(1, "p", "q2", "s2"), (2, "q2", "p", "s2"), (3, "p", "r", "s9")]
    assert ("h2", "s9", "r") in result(spark, processed, cycle)
    repeat = [(1, "z", "y1", "s3"), (2, "z", "y2", "s3"), (3, "z", "y3", "other")]
    for moves in (chain, cycle, repeat, chain + [(m[0] + 9, *m[1:]) for m in cycle], [(1, "nobody", "n1", "u"), (2, "n1", "n2", "u")]):
        assert result(spark, processed, moves) == loop(processed, moves)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moves_are_those_of_a_loop(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(30)]
    processed = [(f"h{k}", f"s{r.randrange(25)}", r.choice(names)) for k in range(40)]
    moves = []
    for seq in range(120):
        old = r.choice(names) if r.random() < 0.9 else f"u{seq}"
        move = (seq * 3, old, r.choice(names), f"s{r.randrange(40)}")
        if left(processed, moves) & left(processed, [*moves, move], only=move):
            continue  # it would leave a row over another one, see the last test
        moves.append(move)
    want = loop(processed, moves)
    taken = [h for h, *_ in want if h.startswith(UNKNOWN)]
    assert len(taken) > 2
    got = result(spark, processed, moves)
    assert [x for x in got if not x[0].startswith(UNKNOWN)] == [x for x in want if not x[0].startswith(UNKNOWN)]
    assert got == want


def test_edges(spark):
    processed = [("h1", "s1", "a"), ("h1", "s1", "a"), ("h2", None, "b"), ("h3", "s3", None)]
    assert result(spark, processed[2:3], []) == [("h2", None, "b")]
    assert result(spark, [], [(1, "a", "b", "s")]) == [("hedef:a", "s", "b")]
    got = result(spark, processed, [(1, "a", "c", "s1"), (2, "b", "d", "s2")])
    assert got.count(("h1", "s1", "c")) == 2 and ("h2", "s2", "d") in got and len(got) == 4
    # Two unknown moves of one name: the last one's row stays.
    assert result(spark, [], [(1, "u", "v", "s1"), (2, "u", "w", "s2")]) == [("hedef:u", "s2", "w")]
