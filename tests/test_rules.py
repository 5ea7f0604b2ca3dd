"""Rules on hand-made rows."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import registry_numbers as R
from folio.functions import text as T
from folio.operators import extraction as X
from folio.operators import layout as L
from folio.operators import pages as P
from folio.operators import registry as G
from folio.operators import votes as V
from folio.plans.flagship import apply_plan
from folio.sources import numbered, read_csv, read_json_map, scan_files, write_csv
from folio.operators.archive import write_state
from folio.streaming.incremental import drop_known, fill_gaps, read_once, run_batches


def col(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").coalesce(1).orderBy("i").select(f(F.col("s"))).collect()]


def test_ids(spark):
    assert col(spark, T.id_valid, ["10000000146", "10000000147", "00000000146", "1000000014", "", None]) == [True, False, False, False, False, False]
    assert col(spark, T.valid_ids, ["No : 10000000146", "No 10000000146", "10000000146 5", "100 000.001-46"]) == [["10000000146"], [], [], ["10000000146"]]


def test_registry_numbers(spark):
    found = col(spark, lambda s: F.array_sort(R.candidates(s)), ["DN47789 32/47789", "DN47789 Sicil No : 35197", "DN4778 32/47789", "SİCİL NO: 35197", "DN123456"])
    assert found == [["47789"], ["35197", "47789"], ["47789"], ["35197"], []]
    taken = [x["value"] for x in col(spark, R.decision, ["DN47789 32/47789", "DN47789 32/11111", "DN4778", "DN47789", "Sicil No : 35197", ""])]
    assert taken == ["47789", "", "", "47789", "", ""]


def test_names(spark):
    assert col(spark, T.plausible_name, ["AYŞE DEMİR", "A1", "", None, "a b c d e", "12345678"]) == [True, False, False, False, False, False]
    assert col(spark, T.fold, ["T.C. Kimlik No", "Adı Soyıdı"]) == ["TCKIMIIKNO", "ADISOYIDI"]
    assert col(spark, T.slug, ["  Ayşe  NUR_Demir ", "__", "João Žižka", "Ş\u0327ahin ²"]) == ["ayse_nur_demir", "", "joao_zizka", "sahin_2"]
    assert col(spark, T.plausible_name, ["Иван Петров", "ŞÜKRÜ", "Ana Žižka"]) == [False, True, True]
    assert col(spark, T.clean_reading, [": yok", "YOK.", "- Ali  veli\nx", ""]) == ["", "YOK", "ALİ VELİ", ""]
    assert col(spark, G.content_key, ["x" * 200 + " \n", "x" * 199]) == [hashlib.sha256(b"x" * 200).hexdigest(), ""]


def test_marks_and_similarity(spark):
    rows = spark.createDataFrame([("AYSE DEMIRCAN", "AYŞE DEMİR"), ("X", "")], "a string, b string")
    assert [r.m for r in rows.select(V.transfer_marks("a", "b").alias("m")).collect()] == ["AYŞE DEMİRCAN", "X"]
    assert rows.select(V.same_person("a", "a").alias("s")).first().s
    assert [r.c for r in spark.createDataFrame([("AYSE", "AYŞE"), ("AY SE", "AYŞE")], "a string, b string").select(V.same_name(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False]


def test_consensus_builds_letters_by_place(spark):
    rows = [("d", 1, "AYSE"), ("d", 2, "AYŞE"), ("d", 3, "ALİ"), ("e", 1, "X"), ("e", 2, ""), ("f", 1, "B"), ("f", 2, "A")]
    got = {r.doc_id: (r.majority, r.votes, r.agreed) for r in V.consensus(spark.createDataFrame(rows, "doc_id string, page_no int, value string")).collect()}
    assert got == {"d": ("AYŞE", 2, "AYŞE"), "e": ("X", 1, ""), "f": ("B", 1, "")}


@pytest.mark.parametrize(("owners", "kinds", "map_", "splittable"), [("A...B.", "aaaaaa", "AAAABB", True), ("A.B.A.", "aaaaaa", "AABBAA", False), ("A.s.B.", "aasaaa", "AA??BB", False), ("A.....", "aaaaaa", "AAAAAA", False), ("..A.B.", "aaaaaa", "AAAABB", True), ("B.C...", "aaaaaa", "BBBBBB", False)])
def test_split_plan(spark, owners, kinds, map_, splittable):
    kind = {"a": "attachment", "s": "suspicious"}
    rows = [("d", i + 1, o if o in "ABC" else None, kind[k]) for i, (o, k) in enumerate(zip(owners, kinds, strict=True))]
    got = P.split_plan(spark.createDataFrame(rows, "doc_id string, page_no int, owner string, page_kind string")).first()
    if "s" not in kinds:
        assert got.map == map_
    assert got.splittable == splittable


def test_collision_names(spark):
    rows = [(1, "x", False), (2, "x", False), (3, "x_2", False), (4, "y", False), (5, "y", False), (0, "z", True), (6, "z", False)]
    got = {r.seq: r.name for r in G.allocate_names(spark.createDataFrame(rows, "seq long, slug string, used boolean")).collect()}
    assert got == {1: "x", 2: "x_2", 3: "x_2_2", 4: "y", 5: "y_2", 0: "z", 6: "z_2"}


def words(spark, rows):
    return spark.createDataFrame([("d", 1, k, float(x0), float(y), float(x1), y + 10.0, w) for k, (x0, x1, y, w) in enumerate(rows)], "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")


def test_layout(spark):
    page = [(10, 28, 20, "Adı"), (30, 60, 20, "Soyadı"), (62, 64, 20, ":"), (70, 120, 20, "AYŞE"), (125, 160, 20, "DEMİR"), (300, 340, 20, "Tarih"), (10, 40, 60, "T.C."), (42, 70, 60, "Kimlik"), (72, 80, 60, "No"), (90, 150, 60, "10000000146"), (10, 60, 90, "Müdür")]
    w = words(spark, page)
    pages = spark.createDataFrame([("d", 1, "DN47789 32/47789")], "doc_id string, page_no int, page_text string")
    got = X.extract(pages, w).first()
    assert (got.name, got.national_id, got.registry_no, got.warning) == ("AYŞE DEMİR", "10000000146", "47789", "")
    count = lambda rows, stems=L.OFFICIAL_STEMS: L.label_boxes(words(spark, rows), L.NAME_LABEL, stems).count()
    assert count(page) == 0 and count(page, ()) == 1  # the official stands 60 points below
    assert count([*page[:3], (10, 60, 96, "Müdür")]) == 1 and count([*page[:3], (181, 220, 50, "Müdür")]) == 1
    assert count([*page[:3], (10, 60, 50, "SicilMemuru")]) == 0
    assert [tuple(r.box) for r in L.label_values(w, L.NAME_LABEL).collect()] == [(62.0, 20.0, 160.0, 30.0)]


def test_extract_looks_at_the_first_number_page_first(spark):
    rows = [(page, x0, y, w) for page, name in ((1, "VELİ. KAYA"), (3, "ALİ DEMİR")) for x0, y, w in [(10, 20, "Adı"), (30, 20, "Soyadı"), *((70 + 40 * k, 20, w) for k, w in enumerate(name.split()))]]
    w = spark.createDataFrame([("d", p, k, float(x), float(y), x + 20.0, y + 10.0, t) for k, (p, x, y, t) in enumerate(rows)], "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    pages = spark.createDataFrame([("d", 1, ""), ("d", 2, "DN12345"), ("d", 3, "DN12345"), ("e", 1, None)], "doc_id string, page_no int, page_text string")
    got = {r.doc_id: r for r in X.extract(pages, w).collect()}
    assert (got["d"].name, got["d"].name_page) == ("VELİ KAYA", 1)
    assert (got["e"].name, got["e"].national_id, got["e"].warnings) == ("", "", ["not found", "id not found", "name not found"])


def test_same_line_matches_every_pair(spark):
    import random

    r = random.Random(5)
    rows = [("d", k % 2, k, 0.0, y, 1.0, y + h, "w") for k in range(150) for y, h in [(r.uniform(0, 200), r.choice([0.0, 3.0, 9.0, 40.0]))]]
    w = spark.createDataFrame(rows, "doc_id string, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    inside = lambda a, b: b[4] < (a[4] + a[6]) / 2 < b[6]
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and (inside(a, b) or inside(b, a)))
    assert sorted((x.a.word_no, x.b.word_no) for x in L.same_line(w).collect()) == want


def test_files_are_numbered_in_order(spark):
    import random

    paths = [f"/in/{k:04d}" for k in range(1000)]
    shuffled = random.Random(1).sample(paths, len(paths))
    got = numbered(spark.createDataFrame([(p, b"") for p in shuffled], "source_path string, content binary").repartition(3))
    assert [(r.source_path, r.seq) for r in got.orderBy("seq").collect()] == [(p, k + 1) for k, p in enumerate(paths)]
    assert numbered(spark.createDataFrame([], "source_path string, content binary")).collect() == []


def test_readings_are_kept(spark):
    def reader(batches):
        for pdf in batches:
            assert set(pdf["key"]) <= {"b"}
            yield pd.DataFrame({"key": pdf["key"], "value": "read"})

    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, page int")
    cache = spark.createDataFrame([("a", "kept"), ("z", "other")], "key string, value string")
    assert {r.key: r.value for r in read_once(wanted, cache, reader, "key string, value string").collect()} == {"a": "kept", "b": "read"}


def test_state_is_written_once(spark, tmp_path):
    actions = spark.createDataFrame([(1, "archive"), (2, "skipped")], "doc_id int, kind string")
    write_state({"actions": actions, "pending": actions}, str(tmp_path / "state"))
    assert sorted(p.name for p in (tmp_path / "state/actions").glob("kind=*")) == ["kind=archive", "kind=skipped"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_state({"actions": actions}, str(tmp_path / "state"))


def test_sources_plan_and_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.pdf", "sub/b.pdf", "c.PDF", "d.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    folder = str(tmp_path / "in")
    assert [r.file_name for r in numbered(scan_files(spark, folder)).orderBy("seq").collect()] == ["a.pdf", "b.pdf"]
    assert scan_files(spark, folder, recursive=False, any_case=True).count() == 2
    df = spark.createDataFrame([("10", 'x "y"\nz'), ("9", "")], "sira string, v string")
    write_csv(df.coalesce(1), str(tmp_path / "csv"), "sira")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv")).collect())) == [("10", 'x "y"\nz'), ("9", "")]
    (tmp_path / "p.json").write_text('{"1": {"ocr": "A"}, "2": {}}')
    assert {r.key: r.value for r in read_json_map(spark, str(tmp_path / "p.json")).collect()} == {"1": {"ocr": "A"}, "2": {}}
    actions = spark.createDataFrame([(1, "archive"), (2, "skipped")], "doc_id int, kind string")
    out = str(tmp_path / "out")
    assert apply_plan(actions, out) == 1 and not (tmp_path / "out").exists()
    apply_plan(actions, out, dry_run=False)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        apply_plan(actions, out, dry_run=False)
    spark.createDataFrame([(1, "h"), (2, "h"), (3, "g")], "seq int, hash string").write.parquet(str(tmp_path / "land"))
    stream = spark.readStream.schema("seq int, hash string").parquet(str(tmp_path / "land"))
    run_batches(drop_known(stream, ["hash"]), lambda b: b, str(tmp_path / "done"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2
    for k in range(2):  # a second run sees more files; what was written is the only state
        again = spark.readStream.schema("seq int, hash string").parquet(str(tmp_path / "land"))
        run_batches(again, lambda b: b, str(tmp_path / "done2"), str(tmp_path / "ck2"), ["hash"]).awaitTermination()
        spark.createDataFrame([(4, "h"), (5, "new")], "seq int, hash string").write.mode("append").parquet(str(tmp_path / "land"))
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "done2")).collect()) == ["g", "h", "new"]


def test_gap_fill_reads_only_empty_fields(spark):
    def reader(batches):
        for pdf in batches:
            assert set(pdf["doc_id"]) <= {"b"}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "value": "read"})

    rows = spark.createDataFrame([("a", "ocr"), ("b", "")], "doc_id string, name string")
    got = {r.doc_id: r.name for r in fill_gaps(rows, "name", reader, "doc_id string, value string").collect()}
    assert got == {"a": "ocr", "b": "read"}


def test_upsert_lineage_suggest(spark):
    base = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "seq int, v string, w string")
    new = spark.createDataFrame([(1, "z"), (2, ""), (3, "q")], "seq int, v string")
    assert sorted(tuple(r) for r in G.upsert(base, new, "seq", ["v"]).collect()) == [(1, "z", "k"), (2, "b", "k")]
    index = spark.createDataFrame([("AHMETYILDIZ",), ("AHMETYILDAN",)], "key string")
    got = G.suggest_person(spark.createDataFrame([("AHMET YILDAR",), ("ALI",)], "name string"), index).collect()
    assert [(r.key, r.distance, r.ambiguous) for r in got] == [("AHMETYILDAN", 1, False)]
    index = spark.createDataFrame([("ALI_VELIOGLU",), ("ABC",), ("AB",)], "key string")
    got = G.suggest_person(spark.createDataFrame([("Ali Velioglu",), ("ABCDE",), ("ABC",)], "name string"), index).collect()
    assert {r.name: (r.key, r.distance) for r in got} == {"Ali Velioglu": ("ALI_VELIOGLU", 0), "ABCDE": ("ABC", 2)}


def test_suggestions_match_every_pair(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("ABC") for _ in range(r.randrange(3, 11)))
    names, keys = {word() for _ in range(60)}, {word() for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n in names:
        near = sorted((distance(n, k), k) for k in keys)
        if len(n) >= 5 and near[0][0] <= 2:
            want[n] = (near[0][1], near[0][0], sum(d == near[0][0] for d, _ in near) > 1)
    got = G.suggest_person(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {x.name: (x.key, x.distance, x.ambiguous) for x in got.collect()} == want
