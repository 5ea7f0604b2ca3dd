"""How often words are dealt: by document or page once, and never joined with themselves."""

from folio import queries
from folio.operators import layout as L

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, n=3):
    rows = [(d, 1, k, x0, 20.0, x1, 30.0, w) for d in range(n) for k, (x0, x1, w) in enumerate([(10.0, 28.0, "Adı"), (30.0, 60.0, "Soyadı"), (70.0, 99.0, "AYŞE")])]
    return spark.createDataFrame(rows, "doc_id long, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string").repartition(3)


def test_words_of_documents_are_not_dealt_again(spark):
    found = plan(queries.queries()["q_same_line"](spark, SF))
    assert found.count("Exchange hashpartitioning") == 1 and "Join" not in found


def test_lines_and_labels_take_one_exchange(spark):
    for df in (L.same_line(words(spark)), L.label_values(words(spark), L.NAME_LABEL), L.label_boxes(words(spark), L.NAME_LABEL)):
        assert plan(df).count("Exchange hashpartitioning") == 1 and "Join" not in plan(df)


def test_labels_found_together_are_those_found_alone(spark):
    labels = (L.NAME_LABEL, L.SPARE_LABEL, L.ID_LABEL)
    for together, alone in ((L.labelled_values, L.label_values), (L.labelled_boxes, L.label_boxes)):
        got = sorted((r.label, *map(str, r[:2]), str(r[3:])) for r in together(words(spark), labels).collect())
        want = sorted((label, *map(str, r[:2]), str(r[2:])) for label in labels for r in alone(words(spark), label).collect())
        assert got == want and len(got) == 6
