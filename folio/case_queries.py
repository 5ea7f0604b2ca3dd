"""Queries over made-up case files, one for each customer, with their SQL.

A case has up to six pages. Which labels, ids, numbers and names stand on them goes by the
customer's key, so that every rule meets all its branches; the SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import archive as A
from folio.operators import extraction as X
from folio.operators import pages as P
from folio.operators import reconcile as R
from folio.operators import review as W
from folio.queries import query, table

# k: the key; m: the kind of case; letters: the key in letters; tc: an id, right for even keys.
CASE_SQL = """WITH p AS (SELECT c_custkey k, c_custkey % 6 m, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') letters, CAST(100000000 + (c_custkey * 7919) % 899999999 AS VARCHAR) s, CAST(10000 + c_custkey % 80000 AS VARCHAR) num FROM customer),
d AS (SELECT *, [CAST(substr(s, i, 1) AS INT) FOR i IN range(1, 10)] x FROM p),
e AS (SELECT *, (((7*(x[1]+x[3]+x[5]+x[7]+x[9]) - (x[2]+x[4]+x[6]+x[8])) % 10) + 10) % 10 t FROM d),
c AS (SELECT k, m, letters, num, s || t || ((list_sum(x) + t) % 10) AS good, s || t || ((list_sum(x) + t + k % 2) % 10) AS tc, k % 2 = 0 AS valid FROM e)
"""


def national_id(prefix: Column, shift: Column) -> Column:
    x = [F.substring(prefix, k, 1).cast("int") for k in range(1, 10)]
    t = F.pmod(7 * (x[0] + x[2] + x[4] + x[6] + x[8]) - (x[1] + x[3] + x[5] + x[7]), F.lit(10))
    return F.concat(prefix, t.cast("string"), ((sum(x[1:], x[0]) + t + shift) % 10).cast("string"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = (F.lit(100000000) + (k * 7919) % 899999999).cast("string")
    own = table(spark, d, "customer").select(k.alias("k"), (k % 6).alias("m"), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ").alias("letters"), (F.lit(10000) + k % 80000).cast("string").alias("num"), s.alias("s"))
    return own.select(F.col("k").alias("doc_id"), "k", "m", "letters", "num", national_id(F.col("s"), F.lit(0)).alias("good"), national_id(F.col("s"), F.col("k") % 2).alias("tc"))


def case_words(spark: SparkSession, d: str) -> DataFrame:
    """Kind 0: a name on both pages, the DN number on the second; 1: one name; 2: a name on the first, the number on the second; 3: no name but behind the spare label on page 2; 4: nothing readable; 5: no label."""
    m, at = F.col("m"), lambda page, x0, x1, y, w: F.struct(F.lit(page).alias("page_no"), F.lit(float(x0)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x1)).alias("x1"), F.lit(y + 10.0).alias("y1"), w.alias("word"))
    label = lambda page, when: [F.when(when, at(page, x0, x1, 20, F.lit(w))) for x0, x1, w in ((10, 28, "Adı"), (30, 60, "Soyadı"), (62, 64, ":"))]
    words = [
        *label(1, m < 5),
        F.when(m < 5, at(1, 70, 120, 20, F.when(m < 3, "BİRİN.Cİ").otherwise("12#/34"))),
        F.when(m < 3, at(1, 125, 160, 20, F.col("letters"))),
        *[F.when(m < 5, at(1, x0, x1, 60, F.lit(w))) for x0, x1, w in ((10, 40, "T.C."), (42, 70, "Kimlik"), (72, 80, "No"))],
        F.when(m < 5, at(1, 90, 150, 60, F.col("tc"))),
        *label(2, m == 0),
        F.when(m == 0, at(2, 70, 120, 20, F.lit("İKİNCİ"))),
        F.when(m == 0, at(2, 125, 160, 20, F.col("letters"))),
        *[F.when(m == 3, at(2, x0, x1, 20, F.lit(w))) for x0, x1, w in ((10, 40, "Soyadı"), (42, 44, ":"))],
        F.when(m == 3, at(2, 50, 90, 20, F.concat(F.lit("DEMİR"), F.col("letters")))),
        F.when(m.isin(0, 2), at(2, 300, 360, 200, F.concat(F.lit("DN"), F.col("num")))),
    ]
    return cases(spark, d).select("doc_id", F.posexplode(F.array(*words)).alias("word_no", "x")).where("x is not null").select("doc_id", "x.page_no", "word_no", "x.x0", "x.y0", "x.x1", "x.y1", "x.word")


def case_pages(spark: SparkSession, d: str) -> DataFrame:
    m, k = F.col("m"), F.col("k")
    number = F.concat(F.lit("DN"), F.col("num"), F.when(m == 0, F.concat(F.lit(" 32/"), F.col("num"))).otherwise(""))
    alone = F.when(k % 4 != 3, F.concat(F.lit("No: "), F.col("tc"), F.lit("\n"))).otherwise(F.concat(F.lit("No: "), F.col("tc"), F.lit("\nNo: 10000000146\n")))
    late = F.lit("Sicil No : 35197")
    texts = F.array(F.lit("first page"), F.when(m.isin(0, 2), number).when(m == 5, alone).otherwise(""), F.lit(""), F.lit(""), F.when((m == 5) & (k % 4 == 3), late).otherwise(""), F.when((m == 5) & (k % 4 == 1), late).otherwise(""))
    return cases(spark, d).select("doc_id", F.posexplode(texts).alias("pos", "page_text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "page_text")


NAME = "CASE m WHEN 0 THEN 'İKİNCİ ' || letters WHEN 1 THEN 'BİRİNCİ ' || letters WHEN 2 THEN 'BİRİNCİ ' || letters WHEN 3 THEN 'DEMİR' || letters ELSE '' END"
REGISTRY = "CASE WHEN m IN (0, 2) THEN num ELSE '' END"


@query(
    CASE_SQL
    + f"""SELECT k AS doc_id, {NAME} AS name, CAST(CASE m WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN NULL ELSE 1 END AS BIGINT) AS name_page, CAST(CASE m WHEN 3 THEN 42 WHEN 5 THEN NULL ELSE 62 END AS DOUBLE) AS name_x0,
CASE WHEN m < 5 AND valid THEN tc ELSE '' END AS national_id, CAST(CASE WHEN m < 5 THEN 1 END AS BIGINT) AS id_page, {REGISTRY} AS registry_no, CAST(CASE WHEN m IN (0, 2) THEN 2 END AS BIGINT) AS registry_page,
array_to_string(list_filter([CASE m WHEN 0 THEN NULL WHEN 2 THEN 'one source' ELSE 'not found' END, CASE WHEN m < 5 AND NOT valid THEN 'id checksum' END, CASE WHEN m = 5 OR NOT valid THEN 'id not found' END, CASE m WHEN 4 THEN 'name unreadable, box kept' WHEN 5 THEN 'name not found' END], lambda x: x IS NOT NULL), ';') AS warnings FROM c"""
)
def q_extract(spark, d):
    found = X.extract(case_pages(spark, d), case_words(spark, d))
    return found.select("doc_id", "name", F.col("name_page").cast("long").alias("name_page"), F.col("name_box.x0").alias("name_x0"), "national_id", F.col("id_page").cast("long").alias("id_page"), "registry_no", F.col("registry_page").cast("long").alias("registry_page"), F.array_join("warnings", ";").alias("warnings"))


@query(CASE_SQL + f""", f AS (SELECT k, m, {NAME} AS name, CASE WHEN m < 5 AND valid THEN tc ELSE '' END AS id, {REGISTRY} AS reg FROM c)
SELECT count(*) AS n_docs, count(*) FILTER (reg <> '') AS n_registry, count(*) FILTER (id <> '') AS n_id, count(*) FILTER (name <> '') AS n_name, count(*) FILTER (reg <> '' AND id <> '' AND name <> '') AS n_all,
count(*) FILTER (m < 4) AS n_clean, CAST(0 AS BIGINT) AS n_light, CAST(0 AS BIGINT) AS n_heavy, count(*) FILTER (name = '') AS n_not_found FROM f""")
def q_coverage(spark, d):
    return X.coverage(X.extract(case_pages(spark, d), case_words(spark, d)))


@query(CASE_SQL + """, w AS (SELECT unnest([CASE m WHEN 0 THEN NULL WHEN 2 THEN 'one source' ELSE 'not found' END, CASE WHEN m < 5 AND NOT valid THEN 'id checksum' END, CASE WHEN m = 5 OR NOT valid THEN 'id not found' END, CASE m WHEN 4 THEN 'name unreadable, box kept' WHEN 5 THEN 'name not found' END]) AS warning FROM c)
SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY 1""")
def q_warning_counts(spark, d):
    return X.warning_counts(X.extract(case_pages(spark, d), case_words(spark, d)))


@query(CASE_SQL + """, n AS (SELECT k, unnest([1, 2, 3, 4, 5, 6]) AS page_no, m, letters, tc, valid FROM c)
SELECT k AS doc_id, CAST(page_no AS BIGINT) AS page_no, CASE WHEN page_no = 1 AND m < 5 AND valid THEN tc WHEN page_no = 1 AND m < 5 AND k % 3 = 0 THEN '10000000146' WHEN page_no = 2 AND m = 5 AND k % 4 = 3 AND NOT valid THEN '10000000146' WHEN page_no = 2 AND m = 5 AND k % 4 <> 3 AND valid THEN tc ELSE '' END AS id,
CASE WHEN page_no = 1 AND m < 3 THEN 'BİRİNCİ ' || letters WHEN page_no = 1 AND m = 4 AND k % 4 = 0 THEN 'OKUNAN AD' WHEN page_no = 2 AND m = 0 THEN 'İKİNCİ ' || letters ELSE '' END AS name FROM n""")
def q_page_owner(spark, d):
    k = F.col("k")
    read = F.array(F.when(k % 3 == 0, F.struct(F.lit("id").alias("field"), F.lit("10000000146").alias("value"))), F.when((F.col("m") == 4) & (k % 4 == 0), F.struct(F.lit("name").alias("field"), F.lit("okunan ad").alias("value"))))
    readings = cases(spark, d).select("doc_id", F.lit(1).alias("page_no"), F.explode(read).alias("x")).where("x is not null").select("doc_id", "page_no", "x.field", "x.value")
    return X.page_owners(case_pages(spark, d), case_words(spark, d), readings).withColumn("page_no", F.col("page_no").cast("long"))


@query(CASE_SQL + "SELECT k AS doc_id, m <> 5 OR k % 4 = 3 AS official FROM c")
def q_official_gate(spark, d):
    return X.official_documents(case_pages(spark, d), case_words(spark, d))


@query(CASE_SQL + ", n AS (SELECT k, m, valid, CASE WHEN m = 5 AND valid THEN 1 ELSE 0 END + CASE WHEN m = 5 AND k % 4 = 3 THEN 1 ELSE 0 END AS n_ids, CASE WHEN m IN (0, 2) OR (m = 5 AND k % 4 IN (1, 3)) THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_registry FROM c) SELECT k AS doc_id, CAST(n_ids + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_ids, CAST(n_registry AS BIGINT) AS n_registry, n_ids + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END > 1 OR n_registry > 1 AS multi FROM n")
def q_multi_identity(spark, d):
    k = F.col("k")
    more = cases(spark, d).select("doc_id", F.lit(7).alias("page_no"), F.concat(F.when(k % 7 == 0, "No: 10000000078\n").otherwise(""), F.when(k % 5 == 0, "Sicil No: 9999").otherwise("")).alias("page_text"))
    found = X.multi_identity(case_pages(spark, d).unionByName(more))
    return found.select("doc_id", F.col("n_ids").cast("long").alias("n_ids"), F.col("n_registry").cast("long").alias("n_registry"), "multi")


@query("SELECT c_custkey AS doc_id, CAST(10 AS DOUBLE) AS x0, CAST(60 AS DOUBLE) AS x1 FROM customer WHERE c_custkey % 5 IN (1, 2, 4)")
def q_block_reject(spark, d):
    """An official's word 60 points below the label, 66 below, to the side, 10 below and inside a longer word, or none."""
    from folio.operators.layout import NAME_LABEL, label_boxes

    m = F.col("m")
    at = lambda x0, x1, y, w: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(y)).alias("y0"), F.lit(w).alias("w"))
    role = F.when(m == 0, at(20, 60, 90, "Memuru")).when(m == 1, at(20, 60, 96, "Memuru")).when(m == 2, at(300, 360, 50, "MÜDÜRLÜĞÜNE")).when(m == 3, at(20, 80, 40, "SicilMemurunun"))
    words = F.array(at(10, 28, 20, "Adı"), at(30, 60, 20, "Soyadı"), role)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 5).alias("m")).select("doc_id", F.posexplode(words).alias("word_no", "x")).where("x is not null")
    placed = rows.select("doc_id", F.lit(1).alias("page_no"), "word_no", "x.x0", "x.y0", "x.x1", (F.col("x.y0") + 10).alias("y1"), F.col("x.w").alias("word"))
    return label_boxes(placed, NAME_LABEL).select("doc_id", "x0", "x1")


# ---- readings --------------------------------------------------------------------------------


def read_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields with OCR's name (plausible, empty, or junk) and numbers (there, or empty with or without a box)."""
    k = F.col("k")
    box = F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))
    return cases(spark, d).select(
        "doc_id", "k", "good", F.when(k % 3 == 0, "AYSE DEMIR").when(k % 3 == 1, "").otherwise("12#").alias("name"), F.when(k % 5 == 0, F.col("good")).otherwise("").alias("national_id"), F.when(k % 5 != 1, box).alias("id_box"), F.lit(1).alias("id_page"), F.when(k % 7 == 0, "12345").otherwise("").alias("registry_no"), F.when(k % 2 == 0, box).alias("registry_box"), F.lit(1).alias("registry_page"), F.array(F.lit("w")).alias("warnings")
    )


@query("""WITH c AS (SELECT c_custkey k FROM customer), n AS (SELECT k, CASE WHEN k % 4 IN (0, 1, 2) THEN CASE WHEN k % 4 = 2 AND k % 3 <> 0 THEN 'Ayşe Demir' ELSE 'AYŞE DEMİR' END ELSE CASE k % 3 WHEN 0 THEN 'AYSE DEMIR' WHEN 1 THEN '' ELSE '12#' END END AS name, k % 4 IN (1, 2) AND k % 3 = 0 AS crossed FROM c)
SELECT k AS doc_id, name, CAST(CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS agreement, crossed, CASE WHEN crossed THEN 'w;name read twice' ELSE 'w' END AS warnings FROM n""")
def q_reconcile(spark, d):
    k, fields = F.col("k"), read_fields(spark, d)
    votes = fields.where("k % 4 < 2").select("doc_id", F.lit("AYŞE DEMİR").alias("majority"), F.when(k % 4 == 0, 3).otherwise(1).alias("votes"), F.when(k % 4 == 0, "AYŞE DEMİR").otherwise("").alias("agreed"))
    crops = fields.where("k % 4 = 2").select("doc_id", F.lit("Ayşe Demir").alias("value"))
    return R.reconcile(fields, votes, crops).select("doc_id", "name", F.col("agreement").cast("long").alias("agreement"), "crossed", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT c_custkey AS doc_id, c_custkey % 4 < 2 AS crossed FROM customer")
def q_cross_method(spark, d):
    from folio.operators.votes import same_name

    m = F.col("k") % 4
    read = F.when(m == 0, "Ayşe  Demir").when(m == 1, "AYSE DEMİR").when(m == 2, "AYŞEDEMİR").otherwise("")
    return cases(spark, d).select("doc_id", (same_name(read, F.lit("AYSE DEMIR")) & (read != "")).alias("crossed"))


@query(CASE_SQL + """, r AS (SELECT *, k % 5 NOT IN (0, 1) AND k % 3 <> 0 AS got, k % 7 <> 0 AND (k % 2 = 0 OR k % 3 = 0) AS num_got FROM c)
SELECT k AS doc_id, CASE WHEN k % 5 = 0 OR got THEN good ELSE '' END AS national_id, CASE WHEN k % 7 = 0 THEN '12345' WHEN num_got THEN CASE WHEN k % 2 = 0 THEN '4321' ELSE '56789' END ELSE '' END AS registry_no,
'w' || CASE WHEN got THEN ';id read' ELSE '' END || CASE WHEN num_got THEN CASE WHEN k % 2 = 0 THEN ';registry read (box)' ELSE ';registry read (strip)' END ELSE '' END AS warnings FROM r""")
def q_gap_fill(spark, d):
    """Readers give an id whose checksum fails for keys divisible by three, and a strip of six digits for others than those."""
    k, fields = F.col("k"), read_fields(spark, d)
    wrong = F.concat(F.substring("good", 1, 10), ((F.substring("good", 11, 1).cast("int") + 1) % 10).cast("string"))
    raw = F.array(F.struct(F.lit("id").alias("field"), F.when(k % 3 == 0, wrong).otherwise(F.concat(F.lit("No "), F.col("good"), F.lit("\n1"))).alias("raw")), F.struct(F.lit("registry").alias("field"), F.lit("no: 43 21").alias("raw")), F.struct(F.lit("strip").alias("field"), F.when(k % 3 == 0, "56789").otherwise("567890").alias("raw")))
    readings = fields.select("doc_id", F.explode(raw).alias("x")).select("doc_id", "x.field", "x.raw")
    return R.fill_numbers(fields, readings).select("doc_id", "national_id", "registry_no", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT c_custkey AS doc_id, field, CAST(1 AS BIGINT) AS page_no, field <> 'strip' AS boxed FROM (SELECT c_custkey, unnest([CASE WHEN c_custkey % 5 NOT IN (0, 1) THEN 'id' END, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'registry' ELSE 'strip' END END]) AS field FROM customer) WHERE field IS NOT NULL")
def q_needed_readings(spark, d):
    return R.needed_readings(read_fields(spark, d)).select("doc_id", "field", F.col("page_no").cast("long").alias("page_no"), F.col("box").isNotNull().alias("boxed"))


# ---- plans and state -------------------------------------------------------------------------

# Names recur among parts; every 23rd row has the text of the row before, every 29th is known from an earlier run.
ACTION_SQL = """WITH p AS (SELECT p_partkey k, regexp_replace(lower(p_name), '[ ]+', '_', 'g') slug, p_name, CASE WHEN p_partkey % 23 = 0 THEN p_partkey - 1 ELSE p_partkey END h FROM part),
a AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'error' WHEN k % 13 = 0 THEN 'unrelated' WHEN k % 11 = 0 THEN CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'split' ELSE 'manual split' END ELSE 'plan' END k0 FROM p),
f AS (SELECT a.*, min(k) FILTER (k0 <> 'plan' OR k % 29 <> 0) OVER (PARTITION BY h) first FROM a),
b AS (SELECT *, CASE WHEN k0 <> 'plan' THEN k0 WHEN k % 29 = 0 OR coalesce(k > first, false) THEN 'skipped' WHEN k % 17 = 0 THEN 'unreadable' WHEN k % 3 = 0 THEN 'verify' ELSE 'archive' END kind FROM f),
g AS (SELECT k, slug, row_number() OVER (PARTITION BY slug ORDER BY k) + CASE WHEN slug = (SELECT min(slug) FROM p) THEN 1 ELSE 0 END r FROM b WHERE kind IN ('archive', 'verify')),
t AS (SELECT b.*, CASE WHEN kind IN ('archive', 'verify') THEN g.slug || CASE WHEN r = 1 THEN '' ELSE '_' || r END || '.pdf' ELSE 'scan' || b.k || '.pdf' END file FROM b LEFT JOIN g USING (k)),
x AS (SELECT t.k, t.p_name, t.h, t.kind, CASE WHEN t.kind = 'skipped' THEN NULL WHEN t.kind = 'split' THEN 'split/original/' || t.file ELSE t.kind || '/' || t.file END AS target,
CASE t.kind WHEN 'skipped' THEN 'same content as ' || CASE WHEN t.k % 29 = 0 THEN 'old' || t.k || '.pdf' ELSE u.file END WHEN 'unreadable' THEN 'no name' WHEN 'verify' THEN 'pages do not agree' WHEN 'error' THEN 'cannot open' WHEN 'unrelated' THEN 'no official mark' WHEN 'split' THEN 'why' WHEN 'manual split' THEN 'why' ELSE '' END AS note FROM t LEFT JOIN t u ON t.first = u.k)
"""


def plan_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, parts = F.col("p_partkey"), table(spark, d, "part")
    h = F.when(k % 23 == 0, k - 1).otherwise(k).cast("string")
    docs = parts.select(k.cast("long").alias("doc_id"), k.cast("long").alias("seq"), F.concat(F.lit("scan"), k, F.lit(".pdf")).alias("source"), F.concat(F.lit("f"), k).alias("file_hash"), F.concat(F.lit("t"), h).alias("text_hash"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 3 == 0, "1").otherwise("").alias("national_id"), F.lit("").alias("registry_no"), F.when(k % 3 == 0, 1).otherwise(2).alias("agreement"), (k % 13 != 0).alias("official"), (k % 11 == 0).alias("multi"), (k % 2 == 0).alias("splittable"), F.lit("why").alias("reason"), F.when(k % 31 == 0, "cannot open").alias("error"), F.array(F.lit("w")).alias("warnings"))
    old = parts.where(k % 29 == 0).select(F.concat(F.lit("f"), k).alias("hash"), F.lit("s").alias("source"), F.concat(F.lit("old"), k, F.lit(".pdf")).alias("target"))
    used = parts.agg(F.min(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")).select(F.lower("name").alias("name"))
    return docs, old, used


@query(ACTION_SQL + "SELECT k AS doc_id, kind, target, CASE WHEN kind IN ('archive', 'verify') THEN p_name END AS name, note FROM x")
def q_plan_actions(spark, d):
    return A.plan_actions(*plan_inputs(spark, d), strict=True).select("doc_id", "kind", "target", F.col("record.name").alias("name"), "note")


@query(ACTION_SQL + """SELECT 'processed' AS state, unnest(['f' || k, 't' || h]) AS key, string_split(target, '/')[-1] AS value FROM x WHERE kind <> 'skipped'
UNION ALL SELECT 'pending', string_split(target, '/')[-1], p_name FROM x WHERE kind = 'verify'
UNION ALL SELECT 'person_index', upper(regexp_replace(p_name, '[ ]+', '_', 'g')), p_name FROM x WHERE kind = 'archive'""")
def q_state_after(spark, d):
    docs, old, used = plan_inputs(spark, d)
    state = A.state_after(A.plan_actions(docs, old, used, strict=True), docs)
    row = lambda name, key, value: state[name].select(F.lit(name).alias("state"), F.col(key).alias("key"), F.col(value).alias("value"))
    return row("processed", "hash", "target").union(row("pending", "file", "suggestion")).union(row("person_index", "key", "name"))


@query("""WITH p AS (SELECT p_partkey k FROM part)
SELECT 'scan' || k || '.pdf' AS name, CASE k % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'split/original' WHEN 2 THEN 'archive' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'verify' END AS folder, CASE k % 6 WHEN 0 THEN 'scan' || k || '.pdf' WHEN 1 THEN 'scan' || k || '.pdf' WHEN 2 THEN 'n' || k || '.pdf' WHEN 3 THEN 'n' || k || '.pdf' WHEN 4 THEN 'scan' || k || '.pdf' END AS file FROM p""")
def q_lineage_lookup(spark, d):
    k, parts = F.col("p_partkey"), table(spark, d, "part")
    m, old, new = k % 6, F.concat(F.lit("scan"), k, F.lit(".pdf")), F.concat(F.lit("n"), k, F.lit(".pdf"))
    at = lambda folder, file: F.struct(F.lit(folder).alias("folder"), file.alias("file"))
    there = F.when(m == 0, F.array(at("source", old), at("archive", new))).when(m == 1, F.array(at("verify", old), at("split/original", old))).when(m == 2, F.array(at("error", new), at("archive", new))).when(m == 3, F.array(at("split", new), at("unreadable", new))).when(m == 4, F.array(at("verify", old))).otherwise(F.array(at("archive", old)))
    files = parts.select(F.explode(there).alias("x")).select("x.*")
    processed = parts.where(m < 4).select(old.alias("source"), new.alias("target"))
    return A.find_files(parts.select(old.alias("name")), files, processed)


@query("""WITH p AS (SELECT p_partkey k FROM part), n AS (SELECT k, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN '??' ELSE 'Ali ' || translate(CAST(k // 10 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS name, k % 7 = 0 AS missing FROM p),
a AS (SELECT k, lower(replace(name, ' ', '_')) slug FROM n WHERE NOT missing AND k % 5 > 1), r AS (SELECT k, slug, row_number() OVER (PARTITION BY slug ORDER BY k) r FROM a)
SELECT n.k AS seq, CASE WHEN k % 3 = 0 THEN 'pend' || k WHEN k % 3 = 1 THEN 'proc' || k ELSE 'q' || k || '.pdf' END AS original, CASE WHEN missing THEN 'not in the queue' WHEN name = '' THEN 'unreadable' WHEN name = '??' THEN 'no file name' ELSE 'archive' END AS kind,
CASE WHEN missing THEN NULL WHEN name = '' THEN CASE WHEN k % 3 = 0 THEN 'pend' || k WHEN k % 3 = 1 THEN 'proc' || k ELSE 'q' || k || '.pdf' END WHEN name <> '??' THEN slug || CASE WHEN r = 1 THEN '' ELSE '_' || r END || '.pdf' END AS target, CASE WHEN NOT missing AND k % 5 > 1 THEN name || '/id' || k END AS record FROM n LEFT JOIN r USING (k)""")
def q_verify_merge(spark, d):
    k, parts = F.col("p_partkey").cast("long"), table(spark, d, "part")
    file = F.concat(F.lit("q"), k, F.lit(".pdf"))
    letters = F.translate(F.floor(k / 10).cast("string"), "0123456789", "ABCDEFGHIJ")
    checked = parts.select(k.alias("seq"), file.alias("file"), F.when(k % 5 == 0, " ").when(k % 5 == 1, "??").otherwise(F.concat(F.lit("Ali "), letters)).alias("true_name"))
    pending = parts.where(k % 3 == 0).select(file.alias("file"), F.concat(F.lit("pend"), k).alias("source"))
    processed = parts.where(k % 3 == 1).select(file.alias("target"), F.concat(F.lit("proc"), k).alias("source"))
    queue, used = parts.where(k % 7 != 0).select(file.alias("file")), parts.select(F.concat(F.lit("q"), k).alias("name"))
    fields = parts.select(file.alias("file"), F.concat(F.lit("id"), k).alias("national_id"), F.lit("").alias("registry_no"))
    found = A.verify_merge(checked, pending, processed, queue, used, fields)
    return found.select("seq", "original", "kind", "target", F.concat_ws("/", "record.name", "record.national_id").alias("record")).withColumn("record", F.when(F.col("kind") == "archive", F.col("record")))


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'no id; several people are near the name, the nearest is A_B: decide by hand' WHEN 1 THEN 'no id; the name suggests A_B (distance 2): confirm by hand' ELSE 'several people, and no id of the first' END AS reason FROM customer")
def q_multi_reason(spark, d):
    m = F.col("k") % 3
    return cases(spark, d).select("doc_id", A.multi_reason(F.when(m < 2, "A_B"), F.when(m < 2, 2), m == 0).alias("reason"))


# ---- review ----------------------------------------------------------------------------------

REVIEW_SQL = """WITH r AS (SELECT c_custkey k, 'c' || c_custkey || '.pdf' AS file, CASE c_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'error' ELSE 'done' END AS state, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'error' WHEN 2 THEN 'archive' WHEN 3 THEN 'unreadable' ELSE 'review' END AS bucket, c_custkey % 4 = 0 AS multi, c_custkey % 3 AS agreement, CASE WHEN c_custkey % 2 = 0 THEN 'AD' ELSE '' END AS name FROM customer)
"""


def review_documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    m = k % 5
    return table(spark, d, "customer").select(k.alias("doc_id"), k.cast("long").alias("seq"), F.concat(F.lit("c"), k, F.lit(".pdf")).alias("file"), F.when(m == 0, "queued").when(m == 1, "error").otherwise("done").alias("state"), F.when(m == 0, "").when(m == 1, "error").when(m == 2, "archive").when(m == 3, "unreadable").otherwise("review").alias("bucket"), F.lit("").alias("why"), F.when(k % 2 == 0, "AD").otherwise("").alias("name"), F.lit("1").alias("national_id"), F.lit("2").alias("registry_no"), (k % 3).alias("agreement"), (k % 4 == 0).alias("multi"), F.lit(4).alias("n_pages"), F.lit("").alias("note"), F.lit("").alias("error"), F.lit(1).alias("version"), F.col("c_nationkey"))


def review_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Four pages each: AABB, A?AA, XXXX or AAXB."""
    k = F.col("c_custkey") % 4
    maps = F.when(k == 0, "AABB").when(k == 1, "A?AA").when(k == 2, "XXXX").otherwise("AAXB")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.split(maps, "")).alias("pos", "letter")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "letter")


@query(REVIEW_SQL + ", b AS (SELECT CASE WHEN state = 'queued' THEN 'queued' ELSE bucket END AS bucket FROM r) SELECT x.bucket, count(b.bucket) AS n FROM (SELECT unnest(['archive', 'review', 'unreadable', 'error', 'queued', 'split']) AS bucket) x LEFT JOIN b USING (bucket) GROUP BY 1")
def q_bucket_counts(spark, d):
    return W.bucket_counts(review_documents(spark, d))


@query(REVIEW_SQL + "SELECT k AS doc_id, CASE WHEN multi THEN 'several people: assign the pages first' ELSE '' END AS problem, CASE WHEN bucket = 'unreadable' THEN '' ELSE name END AS name, CAST(CASE WHEN bucket = 'unreadable' THEN 0 ELSE greatest(agreement, 2) END AS BIGINT) AS agreement FROM r WHERE state = 'done' AND bucket IN ('archive', 'unreadable')")
def q_archive_candidates(spark, d):
    return W.approved(W.archive_candidates(review_documents(spark, d))).select("doc_id", "problem", "name", F.col("agreement").cast("long").alias("agreement"))


@query(REVIEW_SQL + "SELECT k AS doc_id, bucket FROM r WHERE state IN ('queued', 'error')")
def q_job_candidates(spark, d):
    return W.job_candidates(review_documents(spark, d)).select("doc_id", "bucket")


@query(REVIEW_SQL + "SELECT k AS doc_id, CASE k % 7 WHEN 0 THEN 'pages missing' WHEN 1 THEN 'bad letter' ELSE '' END AS problem, multi OR k % 7 IN (2, 3) AS multi, CASE WHEN k % 7 IN (2, 3) THEN 'several people' ELSE '' END AS why FROM r")
def q_assign_pages(spark, d):
    m = F.col("doc_id") % 7
    maps = F.when(m == 0, "AAA").when(m == 1, "AAaA").when(m == 2, "AABB").when(m == 3, "AXAA").when(m == 4, "AA?A")
    docs = review_documents(spark, d)
    return W.assign_pages(docs, docs.select("doc_id", maps.alias("map")).where("map is not null")).select("doc_id", "problem", "multi", "why")


@query(REVIEW_SQL + """SELECT k AS doc_id, CASE WHEN k % 6 = 0 THEN 'NEW' WHEN k % 6 = 1 THEN '' ELSE name END AS name, CASE WHEN k % 6 = 0 THEN '9' ELSE '1' END AS national_id, '2' AS registry_no,
CASE WHEN k % 4 = 3 THEN 'unreadable' WHEN k % 6 = 0 AND bucket = 'unreadable' THEN 'review' ELSE bucket END AS bucket, CASE WHEN k % 4 = 3 THEN 'unreadable' WHEN k % 6 = 0 AND bucket = 'unreadable' THEN 'to verify' ELSE '' END AS why, CASE WHEN k % 4 = 3 THEN 'skipped by hand' ELSE '' END AS note FROM r""")
def q_correct_fields(spark, d):
    docs, m = review_documents(spark, d), F.col("doc_id") % 6
    changes = docs.where(m < 2).select("doc_id", F.when(m == 0, " NEW ").otherwise(" ").alias("name"), F.when(m == 0, "9").alias("national_id"), F.lit(None).cast("string").alias("registry_no"))
    changed = W.skip(W.correct_fields(docs, changes), docs.where("doc_id % 4 = 3"))
    return changed.select("doc_id", "name", "national_id", "registry_no", "bucket", "why", "note")


@query("WITH c AS (SELECT c_custkey k FROM customer), p AS (SELECT k, unnest([1, 2, 3, 4]) page_no, unnest(CASE k % 4 WHEN 0 THEN ['A', 'A', 'B', 'B'] ELSE ['A', 'A', 'X', 'B'] END) letter FROM c WHERE k % 4 IN (0, 3)) SELECT 'c' || k || '_' || letter AS part_id, CAST(page_no AS BIGINT) AS page_no, row_number() OVER (PARTITION BY k, letter ORDER BY page_no) AS new_no FROM p")
def q_split_approved(spark, d):
    parts = W.split_approved(review_documents(spark, d), review_assignment(spark, d))
    return parts.select("part_id", F.col("page_no").cast("long").alias("page_no"), F.col("new_no").cast("long").alias("new_no"))


@query("SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_open, c_custkey % 12 = 5 AS waits, c_custkey % 4 IN (0, 2, 3) AS splits FROM customer")
def q_review_decision(spark, d):
    pages = review_assignment(spark, d)
    return W.decision(pages, F.col("doc_id") % 12 == 5)


# Page 2 of every third document goes before page 1 of the next one, page 4 of every third but one to the end of the next.
@query("""WITH c AS (SELECT c_custkey k FROM customer), p AS (SELECT k, unnest([1, 2, 3, 4]) n FROM c), x AS (SELECT k, n, CASE WHEN k % 3 = 0 AND n = 2 AND k + 1 IN (SELECT k FROM c) THEN k + 1 WHEN k % 3 = 1 AND n = 4 AND k + 1 IN (SELECT k FROM c) THEN k + 1 END AS t, CASE WHEN k % 3 = 0 THEN 1 ELSE 9 END AS spot FROM p)
SELECT coalesce(t, k) AS doc_id, k AS from_doc, CAST(n AS BIGINT) AS from_page, row_number() OVER (PARTITION BY coalesce(t, k) ORDER BY CASE WHEN t IS NULL THEN 2 * n ELSE spot END, k, n) AS page_no FROM x""")
def q_move_pages(spark, d):
    pages = review_assignment(spark, d)
    k, docs = F.col("doc_id"), pages.select("doc_id").distinct()
    moves = docs.where(k % 3 < 2).select("doc_id", F.when(k % 3 == 0, 2).otherwise(4).alias("page_no"), (k + 1).alias("target"), F.when(k % 3 == 0, 1).alias("position"))
    found = W.move_pages(pages, moves.join(docs.select(F.col("doc_id").alias("target")), "target"))
    return found.select("doc_id", "from_doc", F.col("from_page").cast("long").alias("from_page"), F.col("page_no").cast("long").alias("page_no"))


@query("""WITH c AS (SELECT c_custkey k FROM customer), p AS (SELECT k, unnest([1, 2, 3, 4]) n FROM c), x AS (SELECT k, n, CASE WHEN k % 3 = 0 AND n IN (2, 3) THEN -k END AS t FROM p)
SELECT coalesce(t, k) AS doc_id, k AS from_doc, CAST(n AS BIGINT) AS from_page, row_number() OVER (PARTITION BY coalesce(t, k) ORDER BY n) AS page_no FROM x""")
def q_detach_pages(spark, d):
    pages = review_assignment(spark, d)
    gone = pages.where("(doc_id % 3 = 0 and page_no in (2, 3)) or doc_id % 3 = 1").select("doc_id", "page_no", (-F.col("doc_id")).alias("new_doc"))  # all pages of a document stay
    return W.detach_pages(pages, gone).select("doc_id", "from_doc", F.col("from_page").cast("long").alias("from_page"), F.col("page_no").cast("long").alias("page_no"))


@query(REVIEW_SQL + "SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'queued' ELSE state END AS state, CASE WHEN k % 3 = 0 THEN '' ELSE bucket END AS bucket, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM r")
def q_touch(spark, d):
    docs = review_documents(spark, d)
    return W.touch(docs, docs.where("doc_id % 3 = 0")).select("doc_id", "state", "bucket", F.col("version").cast("long").alias("version"))


@query("WITH r AS (SELECT c_custkey k, c_nationkey g FROM customer WHERE c_custkey % 5 = 4), n AS (SELECT k, coalesce(lead(k) OVER (PARTITION BY g ORDER BY k), first_value(k) OVER (PARTITION BY g ORDER BY k)) nx FROM r) SELECT k AS doc_id, CASE WHEN nx <> k THEN nx END AS next FROM n")
def q_next_in_review(spark, d):
    return W.next_in_review(review_documents(spark, d), "c_nationkey")


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'AAAB' WHEN 1 THEN 'ABBB' WHEN 2 THEN 'AACC' ELSE 'AAAA' END AS spread FROM customer")
def q_spread_suggestion(spark, d):
    """Maps ?A?B, AB?? and ??BB, this one with pages of the third person, and ????."""
    k = F.col("c_custkey") % 4
    maps = F.when(k == 0, "?A?B").when(k == 1, "AB??").when(k == 2, "??BB").otherwise("????")
    own = F.when(k == 2, "??CC").otherwise(maps)
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.arrays_zip(F.split(maps, "").alias("suggestion"), F.split(own, "").alias("letter"))).alias("page_no", "x"))
    spread = P.spread_suggestion(pages.select("doc_id", "page_no", "x.suggestion", "x.letter"))
    return spread.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "spread"))), lambda x: x["spread"]), "").alias("spread"))


@query("""SELECT c_custkey AS doc_id, '{"map":"' || CASE WHEN c_custkey % 2 = 0 THEN 'ABB' ELSE 'A??' END || '","second":"' || CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '' END || '","splittable":false,"reason":"' || CASE WHEN c_custkey % 2 = 0 THEN 'interleaved' ELSE 'suspicious page' END || '","pages":[{"no":1,"owner":"A","suggestion":"A","id":"1"},' || CASE WHEN c_custkey % 2 = 0 THEN '{"no":2,"owner":"B","suggestion":"B","id":"2"},{"no":3,"owner":"C","suggestion":"B","id":"3"}]}' ELSE '{"no":2,"owner":"?","suggestion":"?","id":""},{"no":3,"owner":"?","suggestion":"?","id":""}]}' END AS plan FROM customer""")
def q_plan_json(spark, d):
    k = F.col("c_custkey") % 2 == 0
    page = lambda n, owner, kind: F.struct(F.lit(n).alias("page_no"), owner.alias("owner"), kind.alias("page_kind"))
    owned, none = F.lit("owned"), F.lit(None).cast("string")
    rows = F.array(page(1, F.lit("1"), owned), page(2, F.when(k, "2").otherwise(none), F.when(k, "owned").otherwise("suspicious")), page(3, F.when(k, "3").otherwise(none), F.when(k, "owned").otherwise("suspicious")))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")
    return P.plan_json(pages, P.split_plan(pages, "1"), F.lit("1"))


@query(ACTION_SQL + "SELECT k AS doc_id, 'scan' || k || '.pdf ' || kind || CASE WHEN kind IN ('archive', 'verify') THEN ' ' || string_split(target, '/')[-1] ELSE '' END || CASE WHEN k % 3 <> 0 THEN ' [2 pages agree]' WHEN kind = 'archive' THEN ' [no agreement]' ELSE '' END || CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END AS line FROM x")
def q_action_lines(spark, d):
    docs, old, used = plan_inputs(spark, d)
    return W.action_lines(A.plan_actions(docs, old, used, strict=True).join(docs.select("doc_id", "agreement"), "doc_id"))


@query("SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'right' WHEN 1 THEN 'dot only' WHEN 2 THEN 'unread' WHEN 3 THEN 'right' ELSE 'different' END AS class FROM customer")
def q_error_class(spark, d):
    m = F.col("k") % 5
    found = F.when(m == 0, "ALİ VELİ").when(m == 1, "ALI VELİ").when(m == 2, " ").when(m == 3, "ali  veli").otherwise("ALİ VELI X")
    return cases(spark, d).select("k", W.error_class(F.lit("Ali Veli"), found).alias("class"))


@query("SELECT count(*) FILTER (c_custkey % 5 = 0) AS n_absent, count(*) FILTER (c_custkey % 5 = 1) AS n_right, count(*) FILTER (c_custkey % 5 IN (2, 3)) AS n_wrong, count(*) FILTER (c_custkey % 5 = 4) AS n_none, round(count(*) FILTER (c_custkey % 5 = 1) / count(*) FILTER (c_custkey % 5 IN (1, 2, 3)), 6) AS \"precision\", round(count(*) FILTER (c_custkey % 5 IN (1, 2, 3)) / count(*) FILTER (c_custkey % 5 > 0), 6) AS coverage FROM customer WHERE c_custkey % 7 > 0")
def q_consensus_report(spark, d):
    m = F.col("k") % 5
    rows = cases(spark, d).select(F.when(F.col("k") % 7 == 0, "").otherwise("A B").alias("truth"), F.when(m == 0, F.lit(None)).when(m == 1, "A B").when(m < 4, "A C").otherwise("").alias("agreed"))
    return W.consensus_report(rows)


@query("SELECT c_custkey AS id, 'Soru/Ad ' || c_custkey AS turns FROM customer WHERE c_custkey % 4 > 0")
def q_training_rows(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" Ad "), F.col("c_custkey"))).alias("name"))
    made = W.training_rows(rows, "Soru")
    return made.select("id", F.concat_ws("/", F.col("messages")[0]["content"][1]["text"], F.col("messages")[1]["content"][0]["text"]).alias("turns"))


@query("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7') || doc_id) r, round_even(count(*) OVER () * 0.1, 0) n FROM documents) SELECT doc_id, CASE WHEN r <= greatest(n, 1) THEN 'val' ELSE 'train' END AS part FROM h")
def q_train_val(spark, d):
    return W.train_val(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'X Y' ELSE 'ALI VELI 2' END AS suggestion, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '~30 sn' WHEN 2 THEN '~2 dk' ELSE '~2 sa 5 dk' END AS eta, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 66 END AS BIGINT) AS percent FROM customer")
def q_report_texts(spark, d):
    m = F.col("k") % 4
    seconds = F.when(m == 0, 0.0).when(m == 1, 29.6).when(m == 2, 100.0).otherwise(7500.0)
    return cases(spark, d).select("k", W.suggestion_text(F.lit("ali_veli_2.pdf"), F.when(F.col("k") % 2 == 0, "X Y").otherwise("")).alias("suggestion"), T.short_duration(seconds).alias("eta"), W.percent(F.lit(2), F.when(m == 0, 0).otherwise(3)).cast("long").alias("percent"))
