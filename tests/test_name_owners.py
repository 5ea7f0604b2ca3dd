"""Page owners by name against a loop over a document's pages."""

import difflib
import random

from folio.operators.pages import BY_NAME, document_analysis, name_owners, split_plan

PAGE = "doc_id string, page_no int, owner string, page_kind string, name string, prime string, first string"


def alike(a, b):
    return bool(a and b) and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.88)


def loop(pages, prime, first):
    """Owners of one document's (owner, kind, name) in page order."""
    owners = [o for o, _, _ in pages]
    for i, (o, kind, _) in enumerate(pages):
        if o is None and kind == "attachment":
            before = [x for x, _, _ in pages[:i] if x]
            after = [x for x, _, _ in pages[i:] if x]
            owners[i] = before[-1] if before else after[0] if after else None
    second = ""
    for i, (_, kind, name) in enumerate(pages):
        if owners[i] or not name or not first or kind == "suspicious":
            continue
        if alike(name, first):
            owners[i] = prime
        elif not second:
            second, owners[i] = name, BY_NAME + name
        elif alike(name, second):
            owners[i] = BY_NAME + second
    return owners


def test_owners_are_those_of_a_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    names = ["AYŞE YILMAZ", "AYSE YILMAZ", "AYŞE YILMAN", "MEHMET DEMİR", "MEHMET DEMIR", "MEHMED DEMİREL", "ALİ ÖZ", "", None]
    for d in range(150):
        prime, first = rng.choice([("1", "AYŞE YILMAZ"), ("1", "Mehmet Demir"), (BY_NAME + "ALİ ÖZ", "ALİ ÖZ"), ("1", ""), ("1", None)])
        pages = [(rng.choice(["1", "2", None, None, None]), rng.choice(["owned", "owned", "attachment", "suspicious"]), rng.choice(names)) for _ in range(rng.randrange(1, 9))]
        normal = {"Mehmet Demir": "MEHMET DEMİR"}.get(first, first)
        want |= {(f"d{d}", i): o for i, o in enumerate(loop(pages, prime, normal))}
        rows += [(f"d{d}", i, o, k, n, prime, first) for i, (o, k, n) in enumerate(pages)]
    table = spark.createDataFrame(rows, PAGE).repartition(3)
    got = {(r.doc_id, r.page_no): r.owner for r in name_owners(table, table.prime, table["first"]).collect()}
    assert got == want
    assert set(name_owners(table, "1", "X").columns) == set(table.columns)


def test_the_three_branches(spark):
    """Named like the primary person, the first other name, and named like that one; a third name stays open."""
    pages = [("AYŞE YILMAZ", "owned"), ("AYSE YILMAZ", "owned"), ("MEHMET DEMİR", "owned"), ("MEHMET DEMIR", "owned"), ("CAN KAYA", "owned")]
    rows = [("a", i + 1, None, k, n, "7", "AYŞE YILMAZ") for i, (n, k) in enumerate(pages)]
    rows += [("b", 1, None, "owned", "AYŞE YILMAZ", "7", "AYŞE YILMAZ"), ("b", 2, None, "owned", "MEHMET DEMİR", "7", "AYŞE YILMAZ"), ("b", 3, None, "attachment", "", "7", "AYŞE YILMAZ")]
    table = spark.createDataFrame(rows, PAGE)
    plan = {r.doc_id: r for r in split_plan(table, table.prime, table["first"]).collect()}
    assert (plan["a"].map, plan["a"].second, plan["a"].splittable) == ("AABB?", "isim:MEHMET DEMİR", True)
    assert (plan["b"].map, plan["b"].splittable) == ("AB?", True)  # no id, so there was nothing to take when attachments took it


def test_analysis_by_id_by_name_or_not_at_all(spark):
    fields = spark.createDataFrame([("i", "AYŞE YILMAZ", "7", ""), ("n", "Ayşe Yılmaz", "", ""), ("x", "", "", ""), ("s", "AYŞE YILMAZ", "7", ""), ("u", "A", "7", "")], "doc_id string, name string, national_id string, registry_no string")
    multi = spark.createDataFrame([("i", True), ("n", True), ("x", True), ("s", False)], "doc_id string, multi boolean")
    pages = [(d, p, o, "owned", n) for d in "inxs" for p, o, n in ((1, None, "AYŞE YILMAZ"), (2, "9", ""))]
    got = {r.doc_id: (r.multi, r.primary, r.map, r.second, r.splittable) for r in document_analysis(fields, multi, spark.createDataFrame(pages, "doc_id string, page_no int, owner string, page_kind string, name string")).collect()}
    none = (None, None, None)
    assert got == {"i": (True, "7", "AB", "9", True), "n": (True, "isim:AYŞE YILMAZ", "AB", "9", True), "x": (True, None, *none), "s": (False, None, *none), "u": (False, None, *none)}
    empty = document_analysis(fields.limit(0), multi, spark.createDataFrame(pages[:0], "doc_id string, page_no int, owner string, page_kind string, name string"))
    assert empty.collect() == []
