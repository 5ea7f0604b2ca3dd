"""Queries over the whole intended tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, hilbert_ann, html_text, langid, license_scan, mixing, partial_distance, quality_lm, simhash_dedup, spelling, suffix_dedup, token_counts, warc
from folio.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(read_table(spark, sf_dir, "embeddings"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_distance.encode(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_warc, op3_decontaminate, op4_token_counts, op5_suffix_dedup, op6_quality, op7_mixing, op8_html_text, op9_nearest, op10_simhash_dedup]
    return {f.__name__: f for f in [*found, op11_spelling, op12_license_scan, op13_partial_distance]}


# ---- DuckDB SQL of the queries that SQL can express ------------------------------------------

SQL2 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages), q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM q"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL3 = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark),
x AS (SELECT item, least(len(w), 10) n, list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' ')) g FROM b WHERE len(w) > 0),
y AS (SELECT DISTINCT n, unnest(g) g, item FROM x), z AS (SELECT DISTINCT n FROM y),
e AS (SELECT r, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) g FROM d, z WHERE len(w) >= n),
f AS (SELECT r, n, unnest(g) g, unnest(range(1, len(g) + 1)) i FROM e),
h AS (SELECT r, i, n, item FROM f JOIN y USING (n, g)),
p AS (SELECT r, count(DISTINCT k) n_hit FROM (SELECT r, unnest(range(i, i + n)) k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
q AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)"""

SQL5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
p AS (SELECT doc_id, unnest(range(1, CAST(length(h) // 2 AS BIGINT) + 1)) i, h FROM d),
q AS (SELECT doc_id, i, substr(h, CAST(2 * i - 1 AS BIGINT), 2) byte, CASE WHEN 2 * i + 198 <= length(h) THEN md5(substr(h, CAST(2 * i - 1 AS BIGINT), 200)) END s FROM p),
r AS (SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 again FROM q),
g AS (SELECT doc_id, i, byte, max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL gone FROM r),
b AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) first FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) n_removed, count(*) FILTER (first) n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) kept_sha256 FROM b GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

SQL7 = r"""WITH d AS (SELECT row_number() OVER () no, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size, (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END w FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size most, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / sum(w) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM s),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), max(level) OVER () * w) target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END rate FROM t),
goals AS (SELECT *, CAST(floor(rate) AS BIGINT) whole, rate - floor(rate) f, target - floor(rate) * source_size missing FROM g),
e AS (SELECT *, CAST(floor(log2(size + 1) * 8) AS INT) step FROM d),
c AS (SELECT source, step, sum(size) words FROM e GROUP BY ALL), m AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM c),
p AS (SELECT m.source, step, f + f * (1 - f) * (2 * (CASE WHEN source_size > 0 THEN (CAST(before AS DOUBLE) + CAST(words AS DOUBLE) / 2) / source_size ELSE 0.5 END) - 1) p FROM m JOIN goals ON m.source IS NOT DISTINCT FROM goals.source),
k AS (SELECT e.*, p, (u / (1 - u)) / (p / (1 - p)) rank FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.step = p.step),
r AS (SELECT k.*, CASE WHEN p > 0 THEN rank / (1 + rank) ELSE 1 END AS key FROM k),
o AS (SELECT r.*, source_size, target, whole, missing, sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= missing AND p > 0 AS extra FROM r JOIN goals ON r.source IS NOT DISTINCT FROM goals.source),
q AS (SELECT *, missing - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) gap FROM o),
x AS (SELECT source, min(struct_pack(a := abs(size - gap), b := key, c := doc_id, d := size, e := no)).e AS last FROM q WHERE NOT extra AND p > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN extra OR (p > 0 AND coalesce(no = last, false)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM q LEFT JOIN x ON q.source IS NOT DISTINCT FROM x.source"""


def oracle_sql() -> dict[str, str]:
    """Hashes (op10), trained scores (op1, op6), page trees (op8), recurrences (op4) and approximate neighbours (op9) have none."""
    return {"op2_warc": SQL2, "op3_decontaminate": SQL3, "op5_suffix_dedup": SQL5, "op7_mixing": SQL7, "op11_spelling": spelling.SQL, "op12_license_scan": license_scan.sql(), "op13_partial_distance": partial_distance.sql()}
