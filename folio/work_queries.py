"""Queries over case files whose contents are drawn from hashes of their keys, with their SQL.

An order is a document and its lines are the pages, so documents have one to seven pages. Owners, kinds, names,
readings and moves are drawn by ``draw`` from md5 of the key, so combinations occur that nobody wrote down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import pages as P
from folio.queries import query, table
from folio.sources.scratch import tasks_for


def draw(salt: str, n: int, *keys: str) -> Column:
    """A number below ``n`` from the keys' values and the salt."""
    digest = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def draw_sql(salt: str, n: int, *keys: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{salt}')), 1, 8) AS BIGINT) % {n} AS INT)"


# ---- people ----------------------------------------------------------------------------------

FIRST = "AYŞE MEHMET ALİ ÖZGÜR FATMA CAN IŞIL HASAN".split()
LAST = "YILMAZ YILDIZ ÇELİK DEMİR DEMİREL KAYA ÖZ ARSLAN ASLAN KOÇ".split()


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _pick_sql(values: list[str], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{at} + 1]"


def person(n: Column) -> Column:
    """Name of person n, one of 80."""
    return F.concat_ws(" ", _pick(FIRST, F.pmod(n, F.lit(len(FIRST))).cast("int")), _pick(LAST, F.floor(F.pmod(n, F.lit(80)) / len(FIRST)).cast("int")))


def person_sql(n: str) -> str:
    return f"{_pick_sql(FIRST, f'({n}) % {len(FIRST)}')} || ' ' || {_pick_sql(LAST, f'(({n}) % 80) // {len(FIRST)}')}"


# How a name is read: as it is, with a letter replaced, left out or doubled, or with two letters replaced.
def misread(name: Column, how: Column) -> Column:
    letter = lambda at: F.concat(F.substring(name, F.lit(1), F.lit(at - 1)), F.lit("E"), F.substring(name, F.lit(at + 1), F.lit(99)))
    without = F.concat(F.substring(name, 1, 3), F.substring(name, 5, 99))
    doubled = F.concat(F.substring(name, 1, 2), F.substring(name, 2, 99))
    two = F.concat(F.substring(name, 1, 1), F.lit("EE"), F.substring(name, 4, 99))
    return F.when(how == 0, letter(2)).when(how == 1, without).when(how == 2, doubled).when(how == 3, two).otherwise(name)


def misread_sql(name: str, how: str) -> str:
    n = f"({name})"
    return f"CASE {how} WHEN 0 THEN substr({n}, 1, 1) || 'E' || substr({n}, 3) WHEN 1 THEN substr({n}, 1, 3) || substr({n}, 5) WHEN 2 THEN substr({n}, 1, 2) || substr({n}, 2) WHEN 3 THEN substr({n}, 1, 1) || 'EE' || substr({n}, 4) ELSE {n} END"


# ---- pages with ids and names ----------------------------------------------------------------

# p: the primary person; s: the second; by_name: the primary is known by name only.
NAMED_SQL = f"""WITH docs AS (SELECT o_orderkey k, {draw_sql('who', 80, 'o_orderkey')} p, {draw_sql('apart', 3, 'o_orderkey')} ap, {draw_sql('known', 5, 'o_orderkey')} kn FROM orders),
people AS (SELECT k, p, p + [1, 8, 31][ap + 1] s, kn > 0 AS named, kn = 4 AS by_name FROM docs),
drawn AS (SELECT k doc_id, l_linenumber page_no, p, s, {person_sql('p')} primary_name, named, by_name, {draw_sql('owner', 12, 'l_orderkey', 'l_linenumber')} o, {draw_sql('kind', 24, 'l_orderkey', 'l_linenumber')} t,
{draw_sql('name', 10, 'l_orderkey', 'l_linenumber')} nm, {draw_sql('read', 9, 'l_orderkey', 'l_linenumber')} rd FROM people JOIN lineitem ON k = l_orderkey),
pages AS (SELECT doc_id, page_no, CASE WHEN named THEN primary_name ELSE '' END primary_name, CASE WHEN by_name THEN 'isim:' || primary_name ELSE '1' END prime, CASE WHEN o < 2 AND NOT by_name THEN '1' WHEN o = 2 THEN '2' END AS owner,
CASE WHEN t < 5 AND o > 2 THEN 'attachment' WHEN t = 5 AND o > 2 THEN 'suspicious' ELSE 'owned' END page_kind,
CASE WHEN nm < 4 THEN {misread_sql(person_sql('p'), 'rd')} WHEN nm < 7 THEN {misread_sql(person_sql('s'), 'rd')} WHEN nm = 7 THEN {person_sql('s + 5')} ELSE '' END AS name FROM drawn)"""


def named_pages(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Pages with owner, page_kind and name, and their document's prime (the primary owner) and primary_name; and the number of tasks that they are dealt to."""
    key = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(key.alias("l_orderkey"), draw("who", 80, "o_orderkey").alias("p"), draw("apart", 3, "o_orderkey").alias("ap"), draw("known", 5, "o_orderkey").alias("kn"))
    docs = docs.withColumn("s", F.col("p") + F.element_at(F.array(F.lit(1), F.lit(8), F.lit(31)), F.col("ap") + 1))
    on_page = ("l_orderkey", "l_linenumber")
    lines = table(spark, d, "lineitem").select(*on_page)
    tasks = tasks_for(lines)  # keys are few bytes, so partitions by size would hold millions of pages, which are wide once drawn
    rows = docs.repartition(tasks, "l_orderkey").join(lines.repartition(tasks, "l_orderkey"), "l_orderkey")
    rows = rows.withColumns({"o": draw("owner", 12, *on_page), "t": draw("kind", 24, *on_page), "nm": draw("name", 10, *on_page), "rd": draw("read", 9, *on_page)})
    c, by_name = F.col, F.col("kn") == 4
    own = person(c("p"))
    pages = rows.select(
        c("l_orderkey").alias("doc_id"),
        c("l_linenumber").cast("long").alias("page_no"),
        F.when(c("kn") > 0, own).otherwise("").alias("primary_name"),
        F.when(by_name, F.concat(F.lit(P.BY_NAME), own)).otherwise("1").alias("prime"),
        F.when((c("o") < 2) & ~by_name, "1").when(c("o") == 2, "2").alias("owner"),
        F.when((c("t") < 5) & (c("o") > 2), "attachment").when((c("t") == 5) & (c("o") > 2), "suspicious").otherwise("owned").alias("page_kind"),
        F.when(c("nm") < 4, misread(own, c("rd"))).when(c("nm") < 7, misread(person(c("s")), c("rd"))).when(c("nm") == 7, person(c("s") + 5)).otherwise("").alias("name"),
    )
    return pages, tasks


# Ratio of matching runs: the longest run of both (the first one in a, then in b), and so on left and right of it.
RATIO_SQL = """cut AS (SELECT a, b, 0 al, length(a) ah, 0 bl, length(b) bh FROM names UNION ALL
SELECT a, b, x.al, x.ah, x.bl, x.bh FROM (SELECT a, b, unnest([{al: al, ah: m.i, bl: bl, bh: m.j, k: m.k}, {al: m.i - m.k, ah: ah, bl: m.j - m.k, bh: bh, k: m.k}]) x FROM (SELECT *, list_min(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: {k: -len(list_filter(range(1, least(ah - i, bh - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), i: i, j: j})))) m FROM cut WHERE al < ah AND bl < bh)) WHERE x.k < 0 AND x.al < x.ah AND x.bl < x.bh),
run AS (SELECT a, b, list_min(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: -len(list_filter(range(1, least(ah - i, bh - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))))))) k FROM cut),
alike AS (SELECT a, b, 2.0::DOUBLE * -sum(coalesce(k, 0)) / (length(a) + length(b)) >= 0.88 ok FROM run GROUP BY a, b)"""

SPLIT_NAMES_SQL = (
    "WITH RECURSIVE"
    + NAMED_SQL.removeprefix("WITH")
    + """,
filled AS (SELECT *, CASE WHEN owner IS NOT NULL OR page_kind = 'attachment' THEN coalesce(last_value(owner IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), first_value(owner IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END f FROM pages),
opened AS (SELECT *, CASE WHEN f IS NULL AND name <> '' AND primary_name <> '' AND page_kind <> 'suspicious' THEN name END n FROM filled),
names AS (SELECT DISTINCT x.n a, y.b FROM (SELECT doc_id, n FROM opened WHERE n IS NOT NULL) x JOIN (SELECT doc_id, primary_name b FROM opened WHERE n IS NOT NULL UNION SELECT doc_id, n FROM opened WHERE n IS NOT NULL) y USING (doc_id)),
"""
    + RATIO_SQL
    + """,
one AS (SELECT o.*, coalesce(l.ok, false) first FROM opened o LEFT JOIN alike l ON n = l.a AND primary_name = l.b),
two AS (SELECT *, first_value(CASE WHEN NOT first THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) sn FROM one),
own AS (SELECT t.doc_id, page_no, prime, page_kind, coalesce(f, CASE WHEN n IS NULL THEN NULL WHEN first THEN prime WHEN l.ok THEN 'isim:' || sn END) w FROM two t LEFT JOIN alike l ON n = l.a AND sn = l.b),
near AS (SELECT *, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), first_value(w IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) v,
first_value(CASE WHEN w <> prime THEN w END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM own),
lab AS (SELECT *, CASE WHEN v = prime THEN 'A' WHEN v = second THEN 'B' ELSE '?' END l FROM near),
runs AS (SELECT *, coalesce(l <> lag(l) OVER (PARTITION BY doc_id ORDER BY page_no), true) new FROM lab),
plan AS (SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN '?' WHEN w = prime THEN 'A' ELSE 'B' END, '' ORDER BY page_no) AS "map", any_value(second) AS second, count(*) FILTER (new) AS n_blocks, count(*) FILTER (new AND l = '?') others, count(*) FILTER (page_kind = 'suspicious') odd FROM runs GROUP BY doc_id),
found AS (SELECT doc_id, "map", second, n_blocks, CASE WHEN odd > 0 THEN 'suspicious page' WHEN second IS NULL THEN 'no second person' WHEN n_blocks <> 2 THEN 'interleaved' WHEN others > 0 THEN 'third person' ELSE '' END AS reason FROM plan)
"""
)


@query(SPLIT_NAMES_SQL + """SELECT doc_id, "map", second, n_blocks, reason = '' AS splittable, reason FROM found""")
def q_split_names(spark, d):
    pages, tasks = named_pages(spark, d)
    return P.split_plan(pages, F.col("prime"), F.col("primary_name"), tasks)


def analysed(spark: SparkSession, d: str) -> DataFrame:
    pages, tasks = named_pages(spark, d)
    key = F.col("o_orderkey")
    draws = table(spark, d, "orders").select(key.alias("doc_id"), draw("who", 80, "o_orderkey").alias("p"), draw("known", 5, "o_orderkey").alias("kn"), draw("several", 3, "o_orderkey").alias("sv"))
    name = F.when(F.col("kn") > 0, person(F.col("p"))).otherwise("")
    fields = draws.select("doc_id", name.alias("name"), F.when(F.col("kn") == 4, "").otherwise("1").alias("national_id"), F.lit("").alias("registry_no"))
    multi = draws.where("sv < 2").select("doc_id", (F.col("sv") == 1).alias("multi"))
    return P.document_analysis(fields, multi, pages, tasks)


@query(
    SPLIT_NAMES_SQL
    + f""", a AS (SELECT o_orderkey k, {draw_sql('known', 5, 'o_orderkey')} kn, {person_sql(draw_sql('who', 80, 'o_orderkey'))} nm, {draw_sql('several', 3, 'o_orderkey')} = 1 AS multi FROM orders)
SELECT k AS doc_id, multi, CASE WHEN multi THEN CASE WHEN kn = 4 THEN 'isim:' || nm ELSE '1' END END AS "primary", "map", second, CASE WHEN f.doc_id IS NOT NULL THEN reason = '' END AS splittable, reason FROM a LEFT JOIN found f ON k = f.doc_id AND multi"""
)
def q_document_analysis(spark, d):
    return analysed(spark, d).select("doc_id", "multi", "primary", "map", "second", "splittable", "reason")


# ---- moves of processed files ----------------------------------------------------------------

# A customer is a family of names n0 .. n4; each of its orders is a move.
CHAIN_SQL = f"""WITH RECURSIVE processed AS (SELECT c_custkey c, 'h' || c_custkey || '_' || i AS hash, 's' || c_custkey || '_' || i AS source, 'n' || c_custkey || '_' || i AS target FROM customer, range(2) t(i)),
moves AS (SELECT o_custkey c, o_orderkey seq, 'n' || o_custkey || '_' || {draw_sql('old', 5, 'o_orderkey')} AS old, 'n' || o_custkey || '_' || {draw_sql('new', 5, 'o_orderkey')} AS new, 's' || o_custkey || '_' || CASE WHEN {draw_sql('src', 3, 'o_orderkey')} = 0 THEN {draw_sql('of', 3, 'o_orderkey')} ELSE 9 + o_orderkey END AS source FROM orders),
nxt AS (SELECT i.seq, min(j.seq) nx FROM moves i JOIN moves j ON i.c = j.c AND j.seq > i.seq AND (j.old = i.new OR j.source = i.source) GROUP BY i.seq),
entry AS (SELECT hash, p.source, target, min(j.seq) seq FROM processed p LEFT JOIN moves j ON p.c = j.c AND (j.old = p.target OR j.source = p.source) GROUP BY ALL),
own AS (SELECT 'hedef:' || old AS hash, max(seq) seq FROM moves WHERE seq NOT IN (SELECT nx FROM nxt) AND seq NOT IN (SELECT seq FROM entry WHERE seq IS NOT NULL) GROUP BY old),
walk AS (SELECT hash, seq, 0 step FROM entry WHERE seq IS NOT NULL UNION ALL SELECT hash, seq, 0 FROM own UNION ALL SELECT hash, nx, step + 1 FROM walk JOIN nxt USING (seq)),
done AS (SELECT hash, max_by(seq, step) seq FROM walk GROUP BY hash)
SELECT hash, m.source, m.new AS target FROM done JOIN moves m USING (seq) UNION ALL SELECT hash, source, target FROM entry WHERE seq IS NULL"""


@query(CHAIN_SQL)
def q_lineage_chain(spark, d):
    from folio.operators.lineage import retarget

    of = lambda letter, key, n: F.concat(F.lit(letter), F.col(key).cast("string"), F.lit("_"), n.cast("string"))
    processed = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    processed = processed.select(of("h", "c_custkey", F.col("i")).alias("hash"), of("s", "c_custkey", F.col("i")).alias("source"), of("n", "c_custkey", F.col("i")).alias("target"))
    source = F.when(draw("src", 3, "o_orderkey") == 0, draw("of", 3, "o_orderkey").cast("long")).otherwise(F.col("o_orderkey") + 9)
    moves = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), of("n", "o_custkey", draw("old", 5, "o_orderkey")).alias("old"), of("n", "o_custkey", draw("new", 5, "o_orderkey")).alias("new"), of("s", "o_custkey", source).alias("source"))
    return retarget(processed, moves)


# ---- reading in rounds -----------------------------------------------------------------------

MOST_READ = 2
# A page's text: a person's name, misread in various ways, nothing, or a failure.
ROUNDS_SQL = f"""WITH p AS (SELECT l_orderkey doc_id, l_linenumber page_no, {draw_sql('blank', 8, 'l_orderkey', 'l_linenumber')} = 0 AS blank, {draw_sql('box', 6, 'l_orderkey', 'l_linenumber')} > 0 AS boxed, {draw_sql('text', 6, 'l_orderkey', 'l_linenumber')} t,
{misread_sql(person_sql(draw_sql('of', 80, 'l_orderkey')), draw_sql('read', 9, 'l_orderkey', 'l_linenumber'))} AS nm FROM lineitem),
r AS (SELECT doc_id, page_no, CASE WHEN t < 2 THEN '' ELSE nm END AS value, CASE WHEN t = 0 THEN 'ValueError: no picture' END AS error FROM p WHERE NOT blank AND boxed),
b AS (SELECT *, coalesce(sum(CASE WHEN value <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) got FROM r)
SELECT doc_id, CAST(page_no AS BIGINT) page_no, value, error FROM b WHERE got < {MOST_READ}"""


def _page_reader():
    def read(row: dict) -> str:
        if row["t"] == 0:
            raise ValueError("no picture")
        return "" if row["t"] == 1 else row["nm"]

    return read


@query(ROUNDS_SQL)
def q_reading_rounds(spark, d):
    import uuid

    from folio.sources.scratch import shared_folder, written
    from folio.streaming.readings import read_in_rounds, readable

    on_page = ("l_orderkey", "l_linenumber")
    name = misread(person(draw("of", 80, "l_orderkey")), draw("read", 9, *on_page))
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page_no"), draw("blank", 8, *on_page).alias("blank"), draw("box", 6, *on_page).alias("box"), F.col("l_orderkey"), F.col("l_linenumber"))
    wanted = readable(pages, F.col("blank") == 0, F.when(F.col("box") > 0, F.col("box")))
    wanted = wanted.select("doc_id", "page_no", "place", draw("text", 6, *on_page).alias("t"), name.alias("nm"))  # drawn once places are numbered, so that keys alone are dealt
    return read_in_rounds(written(wanted), _page_reader, f"{shared_folder(spark)}/readings-{uuid.uuid4().hex}", MOST_READ)


# ---- labelling and evaluation ----------------------------------------------------------------

# A page has up to two of three ids; boxes of the id's label and of registry numbers stand on some.
LABEL_SQL = f"""WITH p AS (SELECT l_orderkey doc_id, l_linenumber page_no, {draw_sql('ids', 7, 'l_orderkey', 'l_linenumber')} n, {draw_sql('one', 3, 'l_orderkey', 'l_linenumber')} i, {draw_sql('many', 3, 'l_orderkey')} m, {draw_sql('lab', 3, 'l_orderkey', 'l_linenumber')} lb, {draw_sql('reg', 5, 'l_orderkey', 'l_linenumber')} rg, {draw_sql('x', 90, 'l_orderkey', 'l_linenumber')}::DOUBLE x, {draw_sql('y', 120, 'l_orderkey', 'l_linenumber')}::DOUBLE y FROM lineitem),
g AS (SELECT o_orderkey doc_id, {draw_sql('gold', 4, 'o_orderkey')} = 0 AS complete FROM orders),
q AS (SELECT p.*, CASE WHEN n = 0 THEN [0, 1 + i] WHEN n = 1 THEN [CASE WHEN m = 0 THEN i ELSE 0 END] ELSE []::INT[] END ids FROM p JOIN g USING (doc_id) WHERE NOT complete),
d AS (SELECT doc_id, max(page_no) last, len(list_distinct(flatten(list(ids)))) n_ids FROM q GROUP BY doc_id),
ib AS (SELECT doc_id, min(page_no) pg FROM q JOIN d USING (doc_id) WHERE lb = 0 AND n_ids = 1 GROUP BY doc_id), rb AS (SELECT doc_id, min(page_no) pg FROM q WHERE rg = 0 GROUP BY doc_id),
u AS (SELECT DISTINCT doc_id, unnest(range(greatest(page_no - 1, 1), least(page_no + 1, last) + 1)) page FROM q JOIN d USING (doc_id) WHERE len(ids) > 0 AND doc_id NOT IN (SELECT doc_id FROM ib) UNION SELECT doc_id, 1 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM ib)),
r AS (SELECT doc_id, min(page) a, max(page) b FROM (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) k FROM u) GROUP BY doc_id, k),
crops AS (SELECT doc_id, 'id' AS field, pg FROM ib UNION ALL SELECT doc_id, 'registry', pg FROM rb)
SELECT c.doc_id, field, 'crop' AS kind, CAST(pg AS BIGINT) AS first_page, CAST(pg AS BIGINT) AS last_page, CAST(greatest(y - 6, 0) AS DOUBLE) AS y0, CAST(least(x + 36, 100) AS DOUBLE) AS x1, CAST(least(y + 16, 130) AS DOUBLE) AS y1 FROM crops c JOIN q ON c.doc_id = q.doc_id AND page_no = pg
UNION ALL SELECT doc_id, 'id', 'pages', a, b, NULL, NULL, NULL FROM r UNION ALL SELECT doc_id, 'registry', 'pages', 1, 1, NULL, NULL, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM rb)"""


@query(LABEL_SQL)
def q_label_work(spark, d):
    from folio.operators.labelling import label_work
    from folio.sources.scratch import cut

    on_page, c = ("l_orderkey", "l_linenumber"), F.col
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("int").alias("page_no"), draw("ids", 7, *on_page).alias("n"), draw("one", 3, *on_page).alias("i"), draw("many", 3, "l_orderkey").alias("m"), draw("lab", 3, *on_page).alias("lb"), draw("reg", 5, *on_page).alias("rg"), draw("x", 90, *on_page).cast("double").alias("x"), draw("y", 120, *on_page).cast("double").alias("y"))
    rows = cut(rows)
    own = F.when(c("n") == 0, F.array(F.lit(0), c("i") + 1)).when(c("n") == 1, F.array(F.when(c("m") == 0, c("i")).otherwise(0))).otherwise(F.expr("cast(array() as array<int>)"))
    ids = rows.select("doc_id", "page_no", F.transform(own, lambda x: x.cast("string")).alias("ids"))
    box = F.struct(c("x").alias("x0"), c("y").alias("y0"), (c("x") + 30).alias("x1"), (c("y") + 10).alias("y1"))
    boxes = lambda which: rows.where(c(which) == 0).select("doc_id", "page_no", box.alias("box"))
    sizes = rows.select("doc_id", "page_no", F.lit(100.0).alias("page_width"), F.lit(130.0).alias("page_height"))
    number = lambda salt: F.when(draw("gold", 4, "o_orderkey") == 0, "1").when(draw(salt, 2, "o_orderkey") == 0, " ")
    gold = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), number("a").alias("national_id"), number("b").alias("registry_no"))
    found = label_work(gold, ids, boxes("lb"), boxes("rg"), sizes, beside=1)
    return found.select("doc_id", "field", "kind", c("first_page").cast("long").alias("first_page"), c("last_page").cast("long").alias("last_page"), "box.y0", "box.x1", "box.y1")


def drawn_maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Found and true maps of the orders: a letter for each line, in runs; some found ones are missing."""
    c, on_page = F.col, ("l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("n"), draw("true", 5, *on_page).alias("t"), draw("found", 6, *on_page).alias("f"), draw("cut", 4, "l_orderkey").alias("k"), draw("gone", 9, "l_orderkey").alias("g"))
    letter = F.when(c("n") > c("k") + 1, "B").otherwise("A")
    maps = rows.withColumns({"t": F.when(c("t") == 0, "B").otherwise(letter), "f": F.when(c("f") == 0, "?").when(c("f") == 1, "B").otherwise(letter)})
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", x))), lambda y: y[x]), "")
    whole = maps.groupBy("doc_id", "g").agg(joined("t").alias("t"), joined("f").alias("f"))
    return whole.where("g > 0").select("doc_id", F.when(c("g") == 1, F.substring("f", 1, 2)).otherwise(c("f")).alias("map")), whole.select("doc_id", c("t").alias("map"))


@query(f"""WITH p AS (SELECT l_orderkey doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) pos, {draw_sql('true', 5, 'l_orderkey', 'l_linenumber')} t, {draw_sql('found', 6, 'l_orderkey', 'l_linenumber')} f, CASE WHEN l_linenumber > {draw_sql('cut', 4, 'l_orderkey')} + 1 THEN 'B' ELSE 'A' END l, {draw_sql('gone', 9, 'l_orderkey')} g FROM lineitem),
m AS (SELECT doc_id, pos, CASE WHEN t = 0 THEN 'B' ELSE l END a, CASE WHEN g = 0 OR (g = 1 AND pos > 2) THEN NULL WHEN f = 0 THEN '?' WHEN f = 1 THEN 'B' ELSE l END b FROM p),
c AS (SELECT *, a <> lag(a) OVER w AS ca, b <> lag(b) OVER w AS cb FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (a = b) AS n_same, count(*) FILTER (ca) AS n_cuts, count(*) FILTER (cb) AS n_found, count(*) FILTER (ca AND cb) AS n_shared FROM c GROUP BY doc_id""")
def q_split_eval(spark, d):
    from folio.operators.evaluation import split_agreement

    return split_agreement(*drawn_maps(spark, d))


@query(
    SPLIT_NAMES_SQL
    + f""", a AS (SELECT o_orderkey k, {draw_sql('known', 5, 'o_orderkey')} kn, {draw_sql('several', 3, 'o_orderkey')} = 1 AS multi FROM orders WHERE {draw_sql('flag', 4, 'o_orderkey')} = 0)
SELECT count(*) AS n_flagged, count(*) FILTER (NOT multi) AS n_skipped, count(*) FILTER (multi AND reason = '') AS n_splittable, count(*) FILTER (multi AND (reason IS NULL OR reason <> '')) AS n_by_hand FROM a LEFT JOIN found f ON k = f.doc_id"""
)
def q_split_counts(spark, d):
    from folio.operators.evaluation import split_counts

    flagged = table(spark, d, "orders").where(draw("flag", 4, "o_orderkey") == 0).select(F.col("o_orderkey").alias("doc_id"))
    return split_counts(flagged, analysed(spark, d))


# ---- merging documents -----------------------------------------------------------------------

# Of half the orders of a customer two pages each go into a new document; some pages aren't there.
MERGE_SQL = f"""WITH d AS (SELECT o_orderkey k, o_custkey c, 'order' || o_orderkey || CASE WHEN {draw_sql('ext', 3, 'o_orderkey')} > 0 THEN '.pdf' ELSE '' END AS file, {draw_sql('pages', 6, 'o_orderkey')} + 1 AS n, CASE WHEN {draw_sql('bad', 25, 'o_orderkey')} = 0 THEN 9 ELSE 1 END AS pg FROM orders),
s AS (SELECT 'm' || c AS target, 2 * k + i AS position, k, file, n, CASE WHEN i = 0 THEN pg ELSE n END AS page FROM d, range(2) t(i) WHERE {draw_sql('in', 2, 'k')} = 0),
u AS (SELECT target, k, file, min(position) AS fst FROM s GROUP BY ALL), f AS (SELECT target, string_agg(file, ' + ' ORDER BY fst) AS names, count(*) n FROM u GROUP BY target),
p AS (SELECT target, bool_or(page > n) bad, count(*) n_pages, string_agg(k || ':' || page, ',' ORDER BY position) AS pages FROM s GROUP BY target)
SELECT target AS doc_id, CASE WHEN bad THEN NULL WHEN length(names) > 80 THEN 'birlesik_' || n || '_belge.pdf' WHEN lower(names) LIKE '%.pdf' THEN names ELSE names || '.pdf' END AS file, CASE WHEN NOT bad THEN n_pages END AS n_pages, CASE WHEN NOT bad THEN pages END AS pages, CASE WHEN bad THEN 'no such page' ELSE '' END AS problem FROM p JOIN f USING (target)"""


@query(MERGE_SQL)
def q_merge_documents(spark, d):
    from folio.operators.review import merge_documents

    c, key = F.col, "o_orderkey"
    orders = table(spark, d, "orders").withColumns({"n": draw("pages", 6, key) + 1, "page": F.when(draw("bad", 25, key) == 0, 9).otherwise(1), "ext": F.when(draw("ext", 3, key) > 0, ".pdf").otherwise("")})
    documents = orders.select(c(key).alias("doc_id"), F.concat(F.lit("order"), c(key), c("ext")).alias("file"), c("n").cast("long").alias("n_pages"))
    both = F.posexplode(F.array("page", "n")).alias("i", "page_no")
    steps = orders.where(draw("in", 2, key) == 0).select(F.concat(F.lit("m"), "o_custkey").alias("target"), c(key).alias("doc_id"), both)
    merged = merge_documents(documents, steps.withColumn("position", c("doc_id") * 2 + c("i")).drop("i"))
    listed = F.array_join(F.transform("pages", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["page_no"].cast("string"))), ",")
    return merged.withColumn("pages", listed)
