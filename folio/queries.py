"""Queries over the driver's tables, each with DuckDB SQL of its own where SQL can express it.

The tables hold no scanned files, so pages are lines of documents, page owners come from
events per user and day, and registry texts and ids from order and line numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import registry_numbers as R
from folio.functions import text as T
from folio.operators import evaluation as E
from folio.operators import pages as P
from folio.operators import registry as G
from folio.operators import votes as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- ids and registry numbers ----------------------------------------------------------------

IDS_SQL = """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(100000000 + (l_orderkey*7919 + l_linenumber) % 899999999 AS VARCHAR) s FROM lineitem),
d AS (SELECT *, [CAST(substr(s, i, 1) AS INT) FOR i IN range(1, 10)] x FROM p),
e AS (SELECT *, (((7*(x[1]+x[3]+x[5]+x[7]+x[9]) - (x[2]+x[4]+x[6]+x[8])) % 10) + 10) % 10 t FROM d),
ids AS (SELECT l_orderkey, l_linenumber, s || t || ((list_sum(x) + t + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) % 10) AS tc, l_linenumber % 3 <> 0 AS good FROM e)
"""


def ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(100000000) + (F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 899999999
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.cast("string").alias("s"))
    x = [F.substring("s", k, 1).cast("int") for k in range(1, 10)]
    t = F.pmod(7 * (x[0] + x[2] + x[4] + x[6] + x[8]) - (x[1] + x[3] + x[5] + x[7]), F.lit(10))
    last = (sum(x[1:], x[0]) + t + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)) % 10
    return p.select("l_orderkey", "l_linenumber", F.concat("s", t.cast("string"), last.cast("string")).alias("tc"))


@query(IDS_SQL + "SELECT l_orderkey, l_linenumber, tc, good AS valid FROM ids")
def q_id_checksum(spark, d):
    return ids(spark, d).withColumn("valid", T.id_valid(F.col("tc")))


@query(IDS_SQL + "SELECT l_orderkey, CAST(count(DISTINCT tc) FILTER (good) AS BIGINT) n_ids FROM ids GROUP BY 1")
def q_valid_ids(spark, d):
    spaced = F.concat_ws(" ", F.substring("tc", 1, 3), F.substring("tc", 4, 4), F.substring("tc", 8, 4))
    text = ids(spark, d).groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("No: "), spaced))).alias("text"))
    return text.select("l_orderkey", F.size(T.valid_ids(F.col("text"))).cast("long").alias("n_ids"))


@query(IDS_SQL + "SELECT l_orderkey, l_linenumber, substr(tc, 1, 3) || '…' || right(tc, 2) AS masked FROM ids")
def q_mask_id(spark, d):
    return ids(spark, d).select("l_orderkey", "l_linenumber", T.mask_id(F.col("tc")).alias("masked"))


# a: five digits; b: the same, cut to four, another number, or missing, by the key.
REG_SQL = """WITH r AS (SELECT o_orderkey k, CAST(10000 + o_orderkey % 80000 AS VARCHAR) a, o_orderkey % 5 m FROM orders),
s AS (SELECT k, m, CASE WHEN m = 4 THEN '' ELSE a END dn, CASE m WHEN 0 THEN a WHEN 1 THEN substr(a, 1, 4) WHEN 2 THEN CAST(20000 + k % 70000 AS VARCHAR) WHEN 3 THEN '' ELSE substr(a, 1, 4) END pr FROM r)
"""


def registry_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, m = (F.lit(10000) + k % 80000).cast("string"), k % 5
    cut = F.substring(a, 1, 4)
    dn = F.when(m == 4, "").otherwise(F.concat(F.lit("DN"), a, F.lit(" ")))
    pr = F.when(m == 3, "").otherwise(F.concat(F.lit("32/"), F.when(m == 0, a).when(m == 2, (F.lit(20000) + k % 70000).cast("string")).otherwise(cut)))
    return table(spark, d, "orders").select(k.alias("k"), F.concat(dn, pr).alias("text"))


@query(REG_SQL + "SELECT k, CAST(CASE m WHEN 2 THEN CASE WHEN dn = pr THEN 1 ELSE 2 END ELSE 1 END AS BIGINT) n_candidates, CASE WHEN m = 2 THEN least(dn, pr) WHEN m = 4 THEN pr ELSE dn END AS least_candidate FROM s")
def q_registry_candidates(spark, d):
    found = R.candidates(F.col("text"))
    return registry_texts(spark, d).select("k", F.size(found).cast("long").alias("n_candidates"), F.array_min(found).alias("least_candidate"))


@query(REG_SQL + "SELECT k, CASE WHEN m IN (0, 1, 3) OR dn = pr THEN dn ELSE '' END AS number, CASE WHEN m = 0 OR dn = pr THEN '' WHEN m IN (1, 3) THEN 'one source' WHEN m = 2 THEN 'sources differ' ELSE 'four digits' END AS warning FROM s")
def q_registry_decision(spark, d):
    return registry_texts(spark, d).select("k", R.decision(F.col("text")).alias("x")).select("k", F.col("x.value").alias("number"), F.col("x.warning").alias("warning"))


@query("SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_left FROM orders")
def q_prefix_elim(spark, d):
    k = F.col("o_orderkey")
    full = (F.lit(10000) + k).cast("string")
    other = F.when(full.startswith("9"), "8").otherwise("9")  # 99999 would be the start of 999999
    numbers = F.array_distinct(F.array(full, F.substring(full, 1, 4), F.when(k % 10 == 0, full).otherwise(F.concat(other, full))))
    return table(spark, d, "orders").select(k.alias("k"), F.size(R.drop_prefixes(numbers)).cast("long").alias("n_left"))


@query(REG_SQL + """, u AS (SELECT k, unnest([dn, pr]) v, unnest(['d', 'p']) s FROM s), g AS (SELECT k, v, count(DISTINCT s) n, min(s) s FROM u WHERE v <> '' GROUP BY k, v)
SELECT k, count(*) AS n_union, count(*) FILTER (n = 2) AS n_both, count(*) FILTER (n = 1 AND s = 'd') AS n_first_only FROM g GROUP BY k""")
def q_set_ops(spark, d):
    a, b = R._numbers(F.col("text"), R.DN), R._numbers(F.col("text"), R.PROVINCE)
    n = lambda x, name: F.size(x).cast("long").alias(name)
    return registry_texts(spark, d).select("k", n(F.array_union(a, b), "n_union"), n(F.array_intersect(a, b), "n_both"), n(F.array_except(a, b), "n_first_only"))


# ---- pages -----------------------------------------------------------------------------------

PAGES_SQL = """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) x FROM documents),
pages AS (SELECT doc_id, unnest(range(1, len(x) + 1)) page_no, unnest(x) page_text FROM lines),
p AS (SELECT *, length(regexp_replace(page_text, '^\\s+|\\s+$', '', 'g')) n FROM pages)
"""


def line_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "page_text")).select("doc_id", (F.col("pos") + 1).alias("page_no"), "page_text")


@query(PAGES_SQL + "SELECT doc_id, count(*) n_pages, count(*) FILTER (n >= 100) n_text_pages, CAST(median(n) AS DOUBLE) median_chars, median(n) >= 100 AS has_text FROM p GROUP BY doc_id")
def q_page_stats(spark, d):
    return P.page_stats(line_pages(spark, d))


@query(PAGES_SQL + ", m AS (SELECT doc_id, median(n) >= 100 AS has_text FROM p GROUP BY 1) SELECT has_text, count(*) AS n_docs FROM m GROUP BY 1")
def q_text_layer(spark, d):
    return P.page_stats(line_pages(spark, d)).groupBy("has_text").agg(F.count("*").alias("n_docs"))


@query(PAGES_SQL + ", w AS (SELECT *, (doc_id*31 + page_no) % 100 g FROM p) SELECT doc_id, count(*) FILTER (n <= 20 AND (g >= 98 OR (g >= 90 AND g % 10 <= 5))) AS n_blank FROM w GROUP BY doc_id")
def q_blank_pages(spark, d):
    g = F.pmod(F.col("doc_id") * 31 + F.col("page_no"), F.lit(100))
    return line_pages(spark, d).groupBy("doc_id").agg(F.count_if(P.is_blank(F.col("page_text"), g / 100, (g % 10).cast("double"))).alias("n_blank"))


@query(PAGES_SQL + "SELECT CASE WHEN page_no % 3 = 0 THEN 'owned' WHEN n <= 40 THEN 'attachment' ELSE 'suspicious' END AS kind, count(*) AS n_pages FROM p GROUP BY 1")
def q_page_kind(spark, d):
    return line_pages(spark, d).groupBy(P.page_kind(F.col("page_text"), F.col("page_no") % 3 == 0).alias("kind")).agg(F.count("*").alias("n_pages"))


@query(PAGES_SQL + ", f AS (SELECT doc_id, min(page_no) FILTER (contains(page_text, 'tion')) first_page, count(*) n FROM p GROUP BY 1) SELECT first_page, count(*) AS n_docs, min(n) AS least, max(n) AS most FROM f GROUP BY 1")
def q_corpus_stats(spark, d):
    first = line_pages(spark, d).groupBy("doc_id").agg(F.min(F.when(F.contains("page_text", F.lit("tion")), F.col("page_no").cast("long"))).alias("first_page"), F.count("*").alias("n"))
    return first.groupBy("first_page").agg(F.count("*").alias("n_docs"), F.min("n").alias("least"), F.max("n").alias("most"))


# Every third text has a newline more, which its file's hash sees and its content's doesn't.
HASH_SQL = "WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END AS text FROM documents), u AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') s FROM t), h AS (SELECT doc_id, CASE WHEN length(s) >= 200 THEN sha256(s) ELSE '' END text_hash, sha256(text) file_hash FROM u)"


def hashed(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), text.alias("text")).select("seq", G.content_key(F.col("text")).alias("text_hash"), F.sha2("text", 256).alias("file_hash"))


@query(HASH_SQL + " SELECT doc_id AS seq, text_hash, file_hash FROM h")
def q_content_hash(spark, d):
    return hashed(spark, d)


@query(HASH_SQL + " SELECT doc_id AS seq, row_number() OVER (PARTITION BY CASE WHEN text_hash = '' THEN file_hash ELSE text_hash END ORDER BY doc_id) > 1 AS duplicate FROM h")
def q_dedup(spark, d):
    return G.mark_duplicates(hashed(spark, d)).select("seq", "duplicate")


# ---- page owners: events of a user and day as one document -----------------------------------

OWN_SQL = """WITH ev AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') doc_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) page_no,
CASE event_type WHEN 'purchase' THEN 'A' WHEN 'error' THEN 'B' END AS owner, event_id FROM events),
f AS (SELECT *, coalesce(last_value(owner IGNORE NULLS) OVER w, first_value(owner IGNORE NULLS) OVER v) AS who FROM ev
WINDOW w AS (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY doc_id ORDER BY page_no) IS NOT DISTINCT FROM who AND page_no > 1 THEN 0 ELSE 1 END new FROM f),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_no) run FROM c),
blocks AS (SELECT doc_id, run, who, min(page_no) first_page, max(page_no) last_page FROM runs GROUP BY 1, 2, 3)
"""


def event_pages(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "error", "B")
    rows = table(spark, d, "events").withColumn("doc_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id"))  # the plans partition by doc_id too
    return rows.select("doc_id", no.alias("page_no"), owner.alias("owner"), "event_id", F.lit("attachment").alias("page_kind"))


@query(OWN_SQL + "SELECT doc_id, CAST(page_no AS BIGINT) page_no, CASE WHEN owner IS NOT NULL OR event_id % 4 <> 0 THEN who END AS filled FROM f")
def q_owner_fill(spark, d):
    kind = F.when(F.col("event_id") % 4 != 0, "attachment").otherwise("suspicious")
    return P.fill_owners(event_pages(spark, d).withColumn("page_kind", kind)).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "filled")


@query(OWN_SQL + "SELECT doc_id, who, CAST(first_page AS BIGINT) first_page, CAST(last_page AS BIGINT) last_page FROM blocks")
def q_blocks(spark, d):
    out = P.blocks(P.fill_owners(event_pages(spark, d), False).withColumnRenamed("filled", "who"))
    return out.select("doc_id", "who", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"))


@query(OWN_SQL + ", a AS (SELECT doc_id, owner, min(page_no) first FROM ev WHERE owner IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, CASE WHEN length(doc_id) % 2 = 0 THEN 'B' ELSE '' END p FROM a), r AS (SELECT *, CASE WHEN owner = p THEN 1 WHEN p = 'B' THEN 1 + row_number() OVER (PARTITION BY doc_id, owner = p ORDER BY first) ELSE row_number() OVER (PARTITION BY doc_id ORDER BY first) END k FROM b) SELECT ev.doc_id, CAST(ev.page_no AS BIGINT) page_no, coalesce(substr('ABCDEFGH', CAST(k AS INT), 1), '?') AS letter FROM ev LEFT JOIN r ON ev.doc_id = r.doc_id AND ev.owner = r.owner")
def q_owner_letters(spark, d):
    primary = F.when(F.length("doc_id") % 2 == 0, "B")
    return P.owner_letters(event_pages(spark, d), primary).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "letter")


PLAN_SQL = OWN_SQL + """, k AS (SELECT *, owner IS NULL AND event_id % 40 = 0 AS suspicious FROM f),
m AS (SELECT doc_id, string_agg(CASE WHEN suspicious THEN '?' ELSE coalesce(who, '?') END, '' ORDER BY page_no) AS "map", bool_or(suspicious) AS open, bool_or(who = 'B') AS other FROM k GROUP BY 1),
n AS (SELECT doc_id, count(*) n_blocks FROM blocks GROUP BY 1),
plans AS (SELECT m.doc_id, "map", CASE WHEN other THEN 'B' END AS second, n_blocks, CASE WHEN open THEN 'suspicious page' WHEN NOT coalesce(other, false) THEN 'no second person' WHEN n_blocks <> 2 THEN 'interleaved' ELSE '' END AS reason FROM m JOIN n USING (doc_id))
"""


def planned_pages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("owner").isNull() & (F.col("event_id") % 40 == 0), "suspicious").otherwise("attachment")
    return event_pages(spark, d).withColumn("page_kind", kind)


@query(PLAN_SQL + "SELECT doc_id, \"map\", second, n_blocks, reason = '' AS splittable, reason FROM plans")
def q_split_plan(spark, d):
    return P.split_plan(planned_pages(spark, d))


@query(PLAN_SQL + "SELECT b.doc_id || '_part' || first_page || '-' || last_page || '_' || b.who AS part_id, CAST(page_no AS BIGINT) page_no, CAST(page_no - first_page + 1 AS BIGINT) AS new_no FROM plans JOIN blocks b USING (doc_id) JOIN ev ON ev.doc_id = b.doc_id AND page_no BETWEEN first_page AND last_page WHERE reason = ''")
def q_split_pages(spark, d):
    pages = planned_pages(spark, d)
    good = P.split_plan(pages).where("splittable").select("doc_id")
    parts = P.blocks(P.fill_owners(pages, False).withColumnRenamed("filled", "who")).join(good, "doc_id", "left_semi")
    return P.split_pages(pages.select("doc_id", "page_no"), parts).select("part_id", F.col("page_no").cast("long").alias("page_no"), F.col("new_no").cast("long").alias("new_no"))


MAP_SQL = "WITH m AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'AABBA' WHEN 1 THEN 'AX?B' WHEN 2 THEN 'XX' ELSE 'ABZ' END AS \"map\" FROM orders)"


def user_maps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "AABBA").when(k == 1, "AX?B").when(k == 2, "XX").otherwise("ABZ").alias("map"))


@query(MAP_SQL + " SELECT doc_id, \"map\", doc_id % 4 = 0 AS splittable, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'open page' WHEN 2 THEN 'no pages' ELSE 'bad map' END AS reason FROM m")
def q_user_plan(spark, d):
    return P.user_plan(user_maps(spark, d))


@query(MAP_SQL + ", e AS (SELECT doc_id, unnest(range(1, length(\"map\") + 1)) page_no, unnest(string_split(\"map\", '')) letter FROM m) SELECT doc_id, letter, page_no, row_number() OVER (PARTITION BY doc_id, letter ORDER BY page_no) AS new_no FROM e")
def q_map_groups(spark, d):
    return P.map_groups(user_maps(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("page_no", "new_no")})


@query("WITH o AS (SELECT c1.conv_id, c1.turn, c1.text, unnest([2*(1000 - c1.turn), 2*(1000 - c1.turn) + 1]) pos FROM conversations c1 WHERE c1.turn % 2 = 0) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS new_no, md5(text) AS digest FROM o")
def q_page_merge(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    back = 2 * (F.lit(1000) - F.col("page_no"))
    order = pages.where("page_no % 2 = 0").select("doc_id", "page_no", F.col("doc_id").alias("target"), F.explode(F.array(back, back + 1)).alias("position"))
    return P.merge_pages(pages, order).select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), F.col("new_no").cast("long").alias("new_no"), F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS new_no FROM conversations WHERE NOT (turn % 3 = 1)")
def q_page_remove(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"))
    return P.remove_pages(pages, pages.where("page_no % 3 = 1")).select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), F.col("new_no").cast("long").alias("new_no"))


# ---- text functions --------------------------------------------------------------------------

TR_SQL = "WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ışıl ' WHEN 1 THEN 'Çiğdem l' ELSE '  öz' END || c_name AS s FROM customer)"


def turkish(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), F.concat(F.when(k % 3 == 0, "ışıl ").when(k % 3 == 1, "Çiğdem l").otherwise("  öz"), F.col("c_name")).alias("s"))


@query(TR_SQL + " SELECT k, upper(translate(s, 'iı', 'İI')) AS s FROM t")
def q_turkish_upper(spark, d):
    return turkish(spark, d).select("k", T.turkish_upper(F.col("s")).alias("s"))


@query(TR_SQL + " SELECT k, regexp_replace(upper(translate(s, 'ÇĞİIÖŞÜçğıiöşül', 'CGIIOSUCGIIOSUI')), '[^A-Z]', '', 'g') AS s FROM t")
def q_fold(spark, d):
    return turkish(spark, d).select("k", T.fold(F.col("s")).alias("s"))


@query(TR_SQL + " SELECT k, trim(regexp_replace(regexp_replace(upper(translate(trim(s), 'iı', 'İI')), '[^A-ZÇĞİÖŞÜ ]', '', 'g'), ' +', ' ', 'g')) AS s FROM t")
def q_normalize(spark, d):
    return turkish(spark, d).select("k", T.normalize(F.col("s")).alias("s"))


NAMES_SQL = TR_SQL + ", n AS (SELECT k, CASE WHEN k % 6 = 4 THEN 'Иван Петров' WHEN k % 6 = 5 THEN 'AYŞE DEMİR' ELSE s END AS s FROM t)"


@query(NAMES_SQL + ", c AS (SELECT k, s, regexp_replace(s, '[^A-Za-zÇĞİÖŞÜçğıöşü ]', '', 'g') l FROM n) SELECT k, length(l) >= 0.75*length(s) AND length(trim(l)) >= 5 AND len(regexp_extract_all(l, '[^ ]+')) BETWEEN 1 AND 4 AS plausible FROM c")
def q_plausible_name(spark, d):
    k = F.col("k") % 6
    names = turkish(spark, d).withColumn("s", F.when(k == 4, "Иван Петров").when(k == 5, "AYŞE DEMİR").otherwise(F.col("s")))
    return names.select("k", T.plausible_name(F.col("s")).alias("plausible"))


@query(TR_SQL + " SELECT k, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'YOK' ELSE trim(regexp_replace(regexp_replace(upper(translate(trim(s), 'iı', 'İI')), '[^A-ZÇĞİÖŞÜ ]', '', 'g'), ' +', ' ', 'g')) END AS name FROM t")
def q_clean_reading(spark, d):
    raw = F.when(F.col("k") % 5 == 0, ": yok\nnothing").when(F.col("k") % 5 == 1, "- yok.").otherwise(F.concat(F.lit(": - "), F.col("s"), F.lit("\nsecond line")))
    return turkish(spark, d).select("k", T.clean_reading(raw).alias("name"))


@query("SELECT o_orderkey AS k, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) BETWEEN 4 AND 5 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS digits FROM orders")
def q_digit_extract(spark, d):
    raw = F.concat(F.lit("no "), F.concat_ws(" ", F.split(F.col("o_orderkey").cast("string"), "")), F.lit("\n77"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.digits_of(raw, 4, 5).alias("digits"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'joao_zizka_' WHEN 1 THEN 'cigdem_' ELSE '' END || regexp_replace(regexp_replace(trim(lower(p_name)), '[ _]+', '_', 'g'), '[^a-z0-9_]', '', 'g') AS slug FROM part")
def q_slug(spark, d):
    k = F.col("p_partkey")
    before = F.when(k % 3 == 0, "João Žižka_").when(k % 3 == 1, "Çığdem ").otherwise("")
    return table(spark, d, "part").select(k.alias("k"), T.slug(F.concat(F.lit(" _"), before, F.col("p_name"), F.lit("__ "))).alias("slug"))


@query("SELECT p_brand, p_name, CAST(levenshtein(p_name, p_brand || ' ' || p_type) AS BIGINT) AS distance FROM (SELECT DISTINCT p_brand, p_name, p_type FROM part)")
def q_levenshtein(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_name", "p_type").distinct()
    return rows.select("p_brand", "p_name", F.levenshtein("p_name", F.concat_ws(" ", "p_brand", "p_type")).cast("long").alias("distance"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'AYŞE NUR DEMİR' ELSE 'ALİ ÇELİK' END AS merged FROM customer")
def q_merge_spelling(spark, d):
    even = F.col("c_custkey") % 2 == 0
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(even, "AYSE NURDEMİR").otherwise("ALI ÇELIK").alias("a"), F.when(even, "AYŞENUR DEMIR").otherwise("ALİÇELİK").alias("b"))
    return rows.select("k", T.merge_spelling(F.col("a"), F.col("b")).alias("merged"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'AYŞE DEMİR' WHEN 1 THEN 'ÇELİK' ELSE 'AYŞE DEMİRCAN' END AS merged FROM customer")
def q_merge_names(spark, d):
    k = F.col("c_custkey") % 3
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(k == 0, "Ayse Demir").when(k == 1, "").otherwise("AYSE DEMIRCAN").alias("a"), F.when(k == 0, "AYŞEDEMİR").when(k == 1, "çelik").otherwise("AYŞE DEMİR").alias("b"))
    return V.merge_names(rows, "a", "b").select("k", "merged")


# ---- votes -----------------------------------------------------------------------------------

# Readings by word, and with marked letters for two words on some pages: the vote goes by the unmarked word, and then letter by letter.
MARK_SQL = """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') doc_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) n, upper(event_type) w, event_id FROM events),
r AS (SELECT doc_id, n, w, CASE event_id % 3 WHEN 0 THEN translate(w, 'CS', 'ÇŞ') WHEN 1 THEN translate(w, 'OS', 'ÖŞ') ELSE w END v FROM e WHERE n <= 50),
g AS (SELECT doc_id, w, count(*) c, min(n) f FROM r GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) k FROM g),
p AS (SELECT r.doc_id, r.n, b.c votes, i AS pos, substr(v, i, 1) ch, substr(r.w, i, 1) plain FROM r JOIN b ON r.doc_id = b.doc_id AND r.w = b.w AND b.k = 1, range(1, 30) t(i) WHERE i <= length(v)),
q AS (SELECT doc_id, votes, pos, ch, count(*) c, min(n) f, bool_or(ch <> plain) marked FROM p GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY c DESC, marked DESC, f) k FROM q),
x AS (SELECT doc_id, votes, string_agg(ch, '' ORDER BY pos) majority FROM o WHERE k = 1 GROUP BY 1, 2)
SELECT doc_id, majority, votes, CASE WHEN votes >= 2 THEN majority ELSE '' END AS agreed FROM x"""

VOTE_SQL = """WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') doc_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) n, event_type v FROM events),
g AS (SELECT doc_id, v, count(*) c, min(n) f FROM r WHERE n <= 50 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) k FROM g)
"""


def event_readings(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    no = F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.concat_ws("-", "user_id", day).alias("doc_id"), no.alias("page_no"), F.col("event_type").alias("value"))


@query(MARK_SQL)
def q_consensus(spark, d):
    doc = F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    word, m = F.upper("event_type"), F.col("event_id") % 3
    value = F.when(m == 0, F.translate(word, "CS", "ÇŞ")).when(m == 1, F.translate(word, "OS", "ÖŞ")).otherwise(word)
    rows = table(spark, d, "events").select(doc.alias("doc_id"), "ts", "event_id", value.alias("value"))
    return V.consensus(rows.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ts", "event_id"))))


@query(VOTE_SQL + ", f AS (SELECT doc_id, v first, c, k FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f) = 1), x AS (SELECT f.doc_id, first = b.v AS same, b.c >= 2 AS two FROM f JOIN b ON f.doc_id = b.doc_id AND b.k = 1) SELECT count(*) AS n_docs, count(*) FILTER (same) AS first_is_majority, count(*) FILTER (two) AS n_agreed FROM x")
def q_vote_strategies(spark, d):
    readings = event_readings(spark, d)
    first = readings.groupBy("doc_id").agg(F.min_by("value", "page_no").alias("first"))
    return V.consensus(readings).join(first, "doc_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("first") == F.col("majority")).alias("first_is_majority"), F.count_if(F.col("agreed") != "").alias("n_agreed"))


# ---- decisions and state ---------------------------------------------------------------------

ROUTE_SQL = "WITH x AS (SELECT d.doc_id, d.n_chars % 7 <> 0 AS official, d.doc_id % 11 = 0 AS multi, d.doc_id % 2 = 0 AS splittable, CASE WHEN l.quality IS NULL THEN '' ELSE d.lang END AS name, coalesce(l.quality, 0) + coalesce(l.toxic, 0) + d.doc_id % 2 AS votes, row_number() OVER (PARTITION BY md5(d.text) ORDER BY d.doc_id) > 1 AS dup FROM documents d LEFT JOIN labels l USING (doc_id))"


def route_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    first = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("kept"))
    docs = docs.withColumn("h", F.md5("text")).join(first, "h").join(labels, "doc_id", "left")
    return docs.select("doc_id", (F.col("n_chars") % 7 != 0).alias("official"), (F.col("doc_id") % 11 == 0).alias("multi"), (F.col("doc_id") % 2 == 0).alias("splittable"), F.when(F.col("quality").isNull(), "").otherwise(F.col("lang")).alias("name"), (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + F.col("doc_id") % 2).alias("votes"), (F.col("doc_id") > F.col("kept")).alias("dup"))


@query(ROUTE_SQL + " SELECT doc_id, CASE WHEN multi THEN 'review' WHEN name = '' THEN 'unreadable' WHEN votes < 2 AND NOT splittable THEN 'review' ELSE 'archive' END AS bucket FROM x")
def q_bucket(spark, d):
    return route_inputs(spark, d).select("doc_id", G.bucket(F.col("multi"), F.col("name"), F.col("votes"), F.col("splittable")).alias("bucket"))


_ROUTE = " CASE WHEN NOT official THEN 'unrelated' WHEN multi AND splittable THEN 'split' WHEN multi THEN 'manual split' WHEN dup THEN 'skipped' WHEN name = '' THEN 'unreadable' WHEN votes < 2 THEN 'verify' ELSE 'archive' END "


def routed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return route_inputs(spark, d).select("doc_id", "votes", G.route(c("official"), c("dup"), c("multi"), c("splittable"), c("name"), c("votes")).alias("kind"))


@query(ROUTE_SQL + " SELECT doc_id," + _ROUTE + "AS kind FROM x")
def q_route(spark, d):
    return routed(spark, d).select("doc_id", "kind")


@query(ROUTE_SQL + " SELECT" + _ROUTE + "AS kind, count(*) AS n, count(*) FILTER (votes >= 2) AS n_agreed FROM x GROUP BY 1")
def q_summary(spark, d):
    return routed(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("votes") >= 2).alias("n_agreed"))


@query("SELECT p_partkey AS seq, p_name AS slug, CASE WHEN row_number() OVER w = 1 THEN p_name ELSE p_name || '_' || row_number() OVER w END AS name FROM (SELECT p_partkey, regexp_replace(trim(lower(p_name)), '[ _]+', '_', 'g') p_name FROM part) WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def q_collision_names(spark, d):
    slugs = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), T.slug(F.col("p_name")).alias("slug"), F.lit(False).alias("used"))
    return G.allocate_names(slugs).drop("used")


@query("SELECT upper(regexp_replace(trim(lower(p_name)), '[ _]+', '_', 'g')) AS key, count(*) AS n_records, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS records FROM part GROUP BY 1")
def q_person_index(spark, d):
    rows = table(spark, d, "part").groupBy(T.person_key(F.col("p_name")).alias("key")).agg(F.array_sort(F.collect_list("p_partkey")).alias("r"))
    return rows.select("key", F.size("r").cast("long").alias("n_records"), F.array_join("r", ",").alias("records"))


# Names as written (a lower-case l stays one) against keys; some keys and names have few letters.
SUGGEST_SQL = """WITH n AS (SELECT DISTINCT p_name FROM part), k AS (SELECT upper(replace(p_name, ' ', '_')) AS key FROM n UNION SELECT 'ABC' UNION SELECT 'AB'),
g AS (SELECT key, regexp_replace(translate(key, '_', ''), '[^A-Z]', '', 'g') g FROM k),
q AS (SELECT CASE ascii(p_name) % 3 WHEN 0 THEN substr(p_name, 2) WHEN 1 THEN p_name || 'x' ELSE p_name END AS name FROM n UNION SELECT 'abcde' UNION SELECT 'abc' UNION SELECT 'abxy'),
f AS (SELECT name, regexp_replace(upper(name), '[^A-Z]', '', 'g') f FROM q), d AS (SELECT name, key, levenshtein(f, g) d FROM f JOIN g ON length(f) >= 5 AND levenshtein(f, g) <= 2), b AS (SELECT *, min(d) OVER (PARTITION BY name) m FROM d)
SELECT name, min(key) AS key, CAST(min(d) AS BIGINT) AS distance, count(*) > 1 AS ambiguous FROM b WHERE d = m GROUP BY name"""


@query(SUGGEST_SQL)
def q_person_suggest(spark, d):
    own = table(spark, d, "part").select("p_name").distinct()
    few = lambda *v: spark.createDataFrame([(x,) for x in v], "x string")
    index = own.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key")).union(few("ABC", "AB"))
    code = F.ascii("p_name") % 3
    names = own.select(F.when(code == 0, F.expr("substring(p_name, 2)")).when(code == 1, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("name")).union(few("abcde", "abc", "abxy"))
    return G.suggest_person(names, index).withColumn("distance", F.col("distance").cast("long"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS hash, 's' || o_orderkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'new' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'src' || o_orderkey ELSE 't' || o_orderkey END AS target FROM orders UNION ALL SELECT 'target:u' || o_orderkey, 'u' || o_orderkey, 'n' || o_orderkey FROM orders WHERE o_orderkey % 3 = 2")
def q_lineage_update(spark, d):
    k = F.col("o_orderkey").cast("string")
    orders, m = table(spark, d, "orders"), F.col("o_orderkey") % 3
    processed = orders.select(k.alias("hash"), F.concat(F.lit("s"), k).alias("source"), F.concat(F.lit("t"), k).alias("target"))
    old = F.concat(F.when(m == 0, "t").when(m == 1, "s").otherwise("u"), k)
    moves = orders.select(old.alias("old"), F.concat(F.when(m == 0, "new").when(m == 1, "src").otherwise("n"), k).alias("new"))
    return G.update_lineage(processed, moves)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'fixed' || doc_id ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)")
def q_upsert(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("fixed"), "doc_id")).otherwise(F.lit("")).alias("lang"))
    return G.upsert(table(spark, d, "documents").select("doc_id", "lang", "source"), labels, "doc_id", ["lang"])


# ---- evaluation and samples ------------------------------------------------------------------

GOLD_SQL = "WITH x AS (SELECT d.doc_id, lang, CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars % 10 = 0 THEN '' WHEN n_chars > 300 THEN '1' ELSE '0' END AS found FROM labels JOIN documents d USING (doc_id))"


def gold(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.col("n_chars") % 10 == 0, "").when(F.col("n_chars") > 300, "1").otherwise("0")
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "lang", F.col("quality").cast("string").alias("truth"), found.alias("found"))


@query(GOLD_SQL + " SELECT doc_id, CASE WHEN found = '' THEN 'missed' WHEN found = truth THEN 'right' ELSE 'wrong' END AS outcome FROM x WHERE truth IS NOT NULL")
def q_gold_eval(spark, d):
    return gold(spark, d).select("doc_id", E.outcome(F.col("truth"), F.col("found")).alias("outcome")).where("outcome <> 'unmeasurable'")


@query(GOLD_SQL + " SELECT lang, count(*) FILTER (found = truth) AS n_right, count(*) FILTER (found <> '' AND found <> truth) AS n_wrong, count(*) FILTER (found = '') AS n_missed, round(count(*) FILTER (found = truth) / count(*) FILTER (found <> ''), 6) AS \"precision\", round(count(*) FILTER (found <> '') / count(*), 6) AS coverage FROM x WHERE truth IS NOT NULL GROUP BY lang")
def q_precision_coverage(spark, d):
    return E.precision_coverage(gold(spark, d).where("truth is not null"), "lang")


@query(GOLD_SQL + " SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS kind, count(*) FILTER (found = truth) AS one, count(*) FILTER (truth = '1') AS always FROM x WHERE truth IS NOT NULL GROUP BY ROLLUP (lang)")
def q_accuracy_rollup(spark, d):
    g = gold(spark, d).where("truth is not null")
    rows = g.select("lang", "truth", F.explode(F.array(F.struct(F.lit("one").alias("method"), F.col("found").alias("v")), F.struct(F.lit("always").alias("method"), F.lit("1").alias("v")))).alias("x")).select("lang", "x.method", (F.col("x.v") == F.col("truth")).alias("hit"))
    return E.accuracy(rows, "lang", ["one", "always"])


@query(GOLD_SQL + " SELECT CASE WHEN truth = '0' AND found = '' THEN 'neither' WHEN truth = '0' THEN 'second only' WHEN found = '' THEN 'first only' WHEN truth = found THEN 'agree' ELSE 'contradict' END AS pairing, count(*) AS n FROM x WHERE truth IS NOT NULL GROUP BY 1")
def q_source_agreement(spark, d):
    first = F.when(F.col("truth") == "0", "").otherwise(F.col("truth"))
    return gold(spark, d).where("truth is not null").groupBy(E.pairing(first, F.col("found")).alias("pairing")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def q_seeded_sample(spark, d):
    return E.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


@query("WITH n AS (SELECT lang, count(*) c, (SELECT count(*) FROM documents) t FROM documents GROUP BY 1), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) k FROM documents), q AS (SELECT doc_id, lang, k <= round_even(100.0 * c / t, 0) AS own, md5(doc_id || ':7') h FROM r JOIN n USING (lang)) SELECT doc_id, lang FROM q ORDER BY CASE WHEN own THEN 0 ELSE 1 END, h, doc_id LIMIT 100")
def q_stratified(spark, d):
    return E.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 100, 7)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_exclusion(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


# ---- layout: words of documents placed on lines ----------------------------------------------


#: Tasks for each input split of documents once their words stand in rows of their own, some thirty times as many bytes.
WORD_TASKS = 32


def placed_words(spark: SparkSession, d: str) -> DataFrame:
    """All words of documents with boxes: twelve to a row, forty rows to a page; a line of text goes on in the next row.

    Texts are dealt by document before they are cut, so whatever groups words by document and page deals no words again.
    """
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.repartition(WORD_TASKS * docs.rdd.getNumPartitions(), "doc_id")
    cut = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda line: F.split(line, " ")).alias("lines"))
    ends = F.aggregate("lines", F.array(F.lit(0).cast("long")), lambda seen, w: F.concat(seen, F.array(F.element_at(seen, -1) + F.ceil(F.size(w) / 12))))
    lines = cut.withColumn("r", ends).select("doc_id", F.explode(F.arrays_zip("r", "lines")).alias("x")).where("x.lines is not null")
    words = lines.select("doc_id", "x.r", F.posexplode("x.lines").alias("k", "word"))
    words = words.withColumn("row", F.col("r") + F.floor(F.col("k") / 12)).withColumn("page_no", F.floor(F.col("row") / 40).cast("int"))
    x0, y0 = (F.col("k") % 12 * 45).cast("double"), (F.col("row") % 40 * 10).cast("double")
    return words.select("doc_id", "page_no", (F.col("row") * 12 + F.col("k") % 12).alias("word_no"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 8).alias("y1"), "word")


@query(PAGES_SQL + ", w AS (SELECT doc_id, len(string_split(page_text, ' ')) n FROM p) SELECT doc_id, CAST(sum((n // 12) * 144 + (n % 12) * (n % 12)) AS BIGINT) AS n_pairs FROM w GROUP BY doc_id")
def q_same_line(spark, d):
    from folio.operators.layout import same_line

    return same_line(placed_words(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_pairs"))


def _labelled(spark, d):
    """Documents whose second page line carries a label and a value."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("m"))
    words = F.array(*(F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"), F.lit(t).alias("w")) for a, b, t in ((10, 28, "Adı"), (30, 60, "Soyıdı"), (62, 64, ":"))), F.struct(F.lit(70.0).alias("x0"), F.lit(100.0).alias("x1"), F.concat(F.lit("AYŞE"), F.translate(F.col("doc_id").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("w")), F.struct((F.when(F.col("m") == 0, 300.0).otherwise(110.0)).alias("x0"), (F.when(F.col("m") == 0, 340.0).otherwise(150.0)).alias("x1"), F.lit("DEMİR").alias("w")))
    rows = docs.select("doc_id", F.posexplode(words).alias("k", "x"))
    return rows.select("doc_id", F.lit(1).alias("page_no"), F.col("k").alias("word_no"), "x.x0", F.lit(20.0).alias("y0"), "x.x1", F.lit(30.0).alias("y1"), F.col("x.w").alias("word"))


@query("SELECT doc_id, 'AYŞE' || translate(CAST(doc_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' DEMİR' END AS value, CAST(62 AS DOUBLE) AS x0, CAST(CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 150 END AS DOUBLE) AS x1 FROM documents")
def q_label_value(spark, d):
    from folio.operators.layout import label_values

    return label_values(_labelled(spark, d), "ADISOYADI").select("doc_id", "value", "box.x0", "box.x1")


@query("SELECT doc_id, CAST(10 AS DOUBLE) AS x0, CAST(60 AS DOUBLE) AS x1 FROM documents")
def q_label_box(spark, d):
    from folio.operators.layout import label_boxes

    return label_boxes(_labelled(spark, d), "ADISOYADI").select("doc_id", "x0", "x1")


@query(PAGES_SQL + """, st AS (SELECT doc_id, count(*) n_pages, median(n) >= 100 AS has_text FROM p GROUP BY 1),
h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY CASE WHEN length(trim(text)) >= 200 THEN sha256(trim(text)) ELSE sha256(text) END ORDER BY doc_id) > 1 AS duplicate FROM documents),
k AS (SELECT lang, CASE WHEN duplicate THEN 'skipped' WHEN NOT has_text THEN 'unreadable' WHEN n_pages > 12 THEN 'verify' ELSE 'archive' END AS kind FROM h JOIN st USING (doc_id))
SELECT lang, kind, count(*) AS n_docs FROM k GROUP BY 1, 2""")
def q_flagship(spark, d):
    from folio.plans.flagship import document_plan

    return document_plan(table(spark, d, "documents")).groupBy("lang", "kind").agg(F.count("*").alias("n_docs"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def q_first_seen(spark, d):
    from folio.streaming.incremental import first_seen

    return first_seen(table(spark, d, "events"), ["user_id", "event_type"], "event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from folio import case_queries, work_queries  # noqa: F401  they add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from folio import case_queries, work_queries  # noqa: F401

    return dict(SQL)
