"""Readings in rounds against a loop over the pages."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folio.streaming.readings import read_and_vote, read_in_rounds, readable

PAGES = "doc_id string, page_no int, blank boolean, box int, text string"


def loop(pages, most):
    """Pages read and readings of each document, page after page."""
    read, got = [], {}
    for doc, page, blank, box, text in sorted(pages, key=lambda p: (p[0], p[1])):
        if got.get(doc, 0) >= most or blank or box is None:
            continue
        value = "" if text == "fails" else " ".join((text or "").split())
        read.append((doc, page, value, "ValueError: unreadable" if text == "fails" else None))
        got[doc] = got.get(doc, 0) + (value != "")
    return read


def logged_reader(log):
    """Notes each call in a file of its own, so that reads can be counted over tasks."""

    def make():
        def read(row):
            with open(f"{log}/{row['doc_id']}-{row['page_no']}", "a") as f:
                f.write("x")
            if row["text"] == "fails":
                raise ValueError("unreadable")
            return row["text"]

        return read

    return make


def pages_of(seed):
    r = random.Random(seed)
    return [(f"d{d}", p, r.random() < 0.1, r.choice([1, 2, 3, None]), r.choice(["ALİ", "AYŞE", "", " ", None, "fails"])) for d in range(40) for p in range(1, r.randrange(2, 16))]


@pytest.mark.parametrize(("seed", "most"), [(1, 3), (2, 1), (3, 50)])
def test_the_same_pages_as_a_loop(spark, tmp_path, seed, most):
    rows, log = pages_of(seed), tmp_path / "log"
    log.mkdir()
    pages = readable(spark.createDataFrame(rows, PAGES).repartition(3), F.col("blank"), F.col("box"))
    got = read_in_rounds(pages, logged_reader(log), str(tmp_path / "rounds"), most).collect()
    want = loop(rows, most)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert sorted(os.listdir(log)) == sorted(f"{d}-{p}" for d, p, _, _ in want)
    assert all((log / name).read_text() == "x" for name in os.listdir(log))  # once each


def test_a_stopped_run_goes_on_behind_its_last_round(spark, tmp_path):
    rows, log, path = pages_of(5), tmp_path / "log", tmp_path / "rounds"
    log.mkdir()
    pages = readable(spark.createDataFrame(rows, PAGES), F.col("blank"), F.col("box"))
    whole = sorted(map(str, read_in_rounds(pages, logged_reader(log), str(path), 3).collect()))
    calls = sum(len((log / n).read_text()) for n in os.listdir(log))
    (path / "round=1" / "_SUCCESS").unlink()  # it was being written
    again = sorted(map(str, read_in_rounds(pages, logged_reader(log), str(path), 3).collect()))
    assert again == whole
    repeated = sum(len((log / n).read_text()) for n in os.listdir(log)) - calls
    assert 0 < repeated == spark.read.parquet(str(path / "round=1")).count()


def test_votes_and_empty_tables(spark, tmp_path):
    rows = [("a", 1, False, 1, "ali"), ("a", 2, False, 1, "ALİ"), ("a", 3, False, 1, "VELİ"), ("b", 1, True, 1, "X"), ("c", 1, False, 1, "  ")]
    pages = readable(spark.createDataFrame(rows, PAGES), F.col("blank"), F.col("box"))
    make = lambda: lambda row: row["text"]
    assert [tuple(r) for r in read_and_vote(pages, make, str(tmp_path / "one"), 2).collect()] == [("a", "ALİ", 2, "ALİ")]
    assert read_in_rounds(pages.limit(0), make, str(tmp_path / "two")).collect() == []


def test_a_round_keeps_what_the_next_one_goes_by(spark, tmp_path):
    """A round's folder holds each page's place and its document's readings so far, so that the next one needs no earlier round."""
    pages = spark.createDataFrame([("a", p, p, "ALİ" if p == 2 else "") for p in range(1, 4)], "doc_id string, page_no int, place int, text string")
    read_in_rounds(pages, lambda: lambda row: row["text"], str(tmp_path / "rounds"), 2)
    second = spark.read.parquet(str(tmp_path / "rounds" / "round=1")).select("page_no", "place", "_got").collect()
    assert [tuple(r) for r in second] == [(3, 3, 1)]
