"""Boxes, marks, signatures and merges: small rules that queries only reach in passing."""

from pyspark.sql import functions as F

from folio.operators.extraction import crop_boxes
from folio.operators.layout import padded_box, top_strip
from folio.operators.review import after_merge, mark_exactly, merge_documents, seconds_left, signature

DOCUMENTS = "doc_id string, file string, n_pages long, state string, bucket string, why string, version int"


def test_boxes_stay_on_the_page(spark):
    sizes = spark.createDataFrame([(3.0, 4.0, 95.0, 198.0, 100.0, 200.0)], "x0 double, y0 double, x1 double, y1 double, w double, h double")
    c = F.col
    got = sizes.select(padded_box(c("x0"), c("y0"), c("x1"), c("y1"), c("w"), c("h")).alias("b"), top_strip(c("w"), c("h")).alias("t")).first()
    assert tuple(got.b) == (0.0, 0.0, 100.0, 200.0) and tuple(got.t) == (0.0, 0.0, 100.0, 44.0)


def test_the_line_of_a_name_is_cut_to_the_right_edge(spark):
    label = [("d", 1, k, x0, 20.0, x1, 30.0, w) for k, (x0, x1, w) in enumerate(((10.0, 28.0, "Adı"), (30.0, 60.0, "Soyadı"), (62.0, 64.0, ":")))]
    spare = [("e", 2, 0, 1.0, 40.0, 30.0, 50.0, "Soyadı")]
    words = spark.createDataFrame(label + spare + [("f", 1, 0, 1.0, 1.0, 2.0, 2.0, None)], "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    widths = spark.createDataFrame([("d", 1, 500.0), ("e", 2, 400.0), ("f", 1, 300.0)], "doc_id string, page_no int, page_width double")
    got = {r.doc_id: tuple(r.box) for r in crop_boxes(words, widths).collect()}
    assert got == {"d": (8.0, 14.0, 500.0, 36.0), "e": (0.0, 34.0, 400.0, 56.0)}


def test_marks_signatures_and_time_left(spark):
    rows = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "k int, mark string")
    marked = mark_exactly(rows, "k", spark.createDataFrame([(2,), (2,), (9,)], "k int"), "mark", "X")
    assert sorted((r.k, r.mark) for r in marked.collect()) == [(1, ""), (2, "X"), (3, "")]
    shown = "doc_id int, state string, bucket string, why string, version int, name string, national_id string, registry_no string, agreement int, error string"
    a, b, again = (1, "done", "archive", "", 1, "A", "", "", 2, None), (2, "done", "archive", "", 1, "A", "", "", 2, None), (3, "done", "archive", "", 2, "A", "", "", 2, None)
    by = {r.doc_id: r.signature for r in signature(spark.createDataFrame([a, b, again], shown)).collect()}
    assert by[1] == by[2] != by[3]
    times = spark.createDataFrame([(30.0, 3, 5), (30.0, 0, 5), (30.0, 5, 5)], "e double, d int, t int").select(seconds_left(F.col("e"), F.col("d"), F.col("t")).alias("s"))
    assert [r.s for r in times.collect()] == [20.0, None, 0.0]


def test_merged_documents_are_queued_and_their_sources_done(spark):
    documents = spark.createDataFrame([("a", "a.pdf", 3, "done", "review", "", 1), ("b", "b", 1, "done", "archive", "", 2), ("c", "c" * 90 + ".pdf", 2, "done", "review", "x", 1)], DOCUMENTS)
    steps = [("new", 1, "b", 1), ("new", 2, "a", 3), ("new", 3, "a", 1), ("new", 4, "b", 1), ("long", 1, "c", 2), ("bad", 1, "a", 4), ("none", 1, "z", 1), ("zero", 1, "a", 0)]
    merged = merge_documents(documents, spark.createDataFrame(steps, "target string, position int, doc_id string, page_no int"))
    got = {r.doc_id: r for r in merged.collect()}
    assert got["new"].file == "b + a.pdf" and got["new"].n_pages == 4 and got["long"].file == "birlesik_1_belge.pdf"
    assert [tuple(p) for p in got["new"].pages] == [(1, "b", 1), (2, "a", 3), (3, "a", 1), (4, "b", 1)]
    assert {d for d, r in got.items() if r.problem} == {"bad", "none", "zero"} and got["bad"].pages is None
    after = {r.doc_id: tuple(r)[3:] for r in after_merge(documents, merged).collect()}
    assert after == {"a": ("done", "split", "merged into new", 1), "b": ("done", "split", "merged into new", 2), "c": ("done", "split", "merged into long", 1), "new": ("queued", "", "", 1), "long": ("queued", "", "", 1)}
