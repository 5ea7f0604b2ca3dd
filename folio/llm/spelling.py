"""Spelling variants by Aho-Corasick automata over the halves of words.

A word and one that differs from it in a single code point (inserted, deleted or replaced)
have one half of the first in common: its first half starts the other word, or its second
half ends it. So automata hold both halves of every word, in shards of bounded size; words
are scanned by them, a half that is found counts if its offset and its word's length fit,
and what is left of both words is compared.

A half belongs to a shard by its first ``LEAD`` code points. A word has few places where a
half can fit, so it is scanned by the shards of these alone. Leads with more than ``SHARD``
halves are split: cells of a grid hold a part of the halves each and scan a part of the
words each. A half that more than ``BUCKET`` words share isn't compared with each of them:
these are looked up by the rest of the word with one code point left out. A task returns
what it counts for each word, not pairs of words.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, broadcast_if_small, discard, materialize

LEAST, OCCURS, TIMES = 6, 5, 5
#: One run of so many, by its hash, has a code point deleted.
DAMAGE = 199
LEAD, SHARD, BUCKET = 3, 50_000, 32
#: Up to this length the rest of a word is cut into strings, beyond it into hashes.
SHORT, BASE, PRIME = 64, 1_000_003, (1 << 61) - 1


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurs: int = OCCURS, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``occurs`` times."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))  # shorter ones give no word
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run")).where("run is not null")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = run.withColumn("h", h).select(F.when(F.pmod("h", F.lit(damage)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurs)


def differs_once(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def deletions(s: str) -> set:
    """A key of s itself and of each string that s is with one code point left out."""
    if len(s) <= SHORT:
        return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}
    head, power = [0], [1]
    for c in s:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    tail, found = 0, {(len(s), head[-1])}
    for i in range(len(s) - 1, -1, -1):  # tail: hash of what stands behind i
        found.add((len(s) - 1, (head[i] * power[len(s) - 1 - i] + tail) % PRIME))
        tail = (ord(s[i]) * power[len(s) - 1 - i] + tail) % PRIME
    return found


class Halves:
    """An automaton over halves, with the words that have each."""

    def __init__(self, owners: list[tuple[int, str, int]]) -> None:
        """owners: which half (0 or 1), word and its count."""
        self.words: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for kind, word, n in owners:
            h = len(word) // 2
            half, rest = (word[:h], word[h:]) if kind == 0 else (word[h:], word[:h])
            self.words[half][kind].append((rest, word, n))
        self.automaton = ahocorasick.Automaton()
        for half in self.words:
            self.automaton.add_word(half, half)
        self.automaton.make_automaton()
        self.by_rest: dict[tuple[str, int], dict] = {}

    def _with_half(self, half: str, kind: int, rest: str) -> list:
        """The words to compare with one whose rest this is: all that share the half, or those that share a shortened rest."""
        own = self.words[half][kind]
        if len(own) <= BUCKET:
            return own
        if (half, kind) not in self.by_rest:
            index = self.by_rest[half, kind] = defaultdict(list)
            for x in own:
                for key in deletions(x[0]):
                    index[key].append(x)
        index = self.by_rest[half, kind]
        return list({x[1]: x for key in deletions(rest) for x in index.get(key, ())}.values())

    def near(self, word: str) -> tuple[int, int, str | None]:
        """How many words are near, and count and spelling of the commonest (ties: the smallest in code-point order)."""
        found, best, length = 0, (0, None), len(word)
        for end, half in self.automaton.iter(word):
            size = len(half)
            places = []
            if end == size - 1 and size * 2 - 1 <= length <= size * 2 + 2:
                places.append((0, word[size:]))
            if end == length - 1 and size * 2 - 2 <= length <= size * 2 + 1:
                places.append((1, word[: length - size]))
            for kind, rest in places:
                for other_rest, other, n in self._with_half(half, kind, rest):
                    if abs(len(other) - length) > 1 or not differs_once(rest, other_rest):
                        continue
                    if kind and word.startswith(other[: len(other) // 2]):
                        continue  # found by its first half
                    found += 1
                    if best[1] is None or (-n, other) < (-best[0], best[1]):
                        best = n, other
        return found, *best


def _scan(batches):
    """Rows (lead, bin, chunk, role, kind, word, n) in order: a cell's halves, role 0, and then the words that it scans."""
    cell, owners, automaton, last = None, [], None, None
    for batch in batches:
        out = []
        for *key, role, kind, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != cell:
                cell, owners, automaton, last = key, [], None, None
            if role == 0:
                owners.append((kind, word, n))
            elif owners and word != last:  # a word may have two places in one shard
                automaton, last = automaton or Halves(owners), word
                if (found := automaton.near(word))[0]:
                    out.append((word, *found))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), a written table, that have near ones."""
    length = F.length("word")
    half = F.floor(length / 2).cast("int")
    owners = words.select("word", "n", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.substring("word", at, F.lit(LEAD)).alias("lead")) for k, at in enumerate((F.lit(1), half + 1))))))
    # The second half of a word of one code point less, as many, or one more would start here.
    starts = F.array(F.lit(1), *(length - F.ceil((length + d) / 2).cast("int") + 1 for d in (-1, 0, 1)))
    fits = F.array_distinct(F.transform(F.filter(starts, lambda p: p > 0), lambda p: F.substring("word", p, F.lit(LEAD))))
    probes = words.select("word", F.explode(fits).alias("lead"))

    sizes = materialize(owners.groupBy("lead").agg(F.count("*").alias("c")))
    bins = max(1, -(-(sizes.agg(F.sum("c")).first()[0] or 0) // shard))
    # At most one lead for every ``shard`` halves is among these.
    hot = broadcast_if_small(sizes.where(F.col("c") > shard).select("lead", F.ceil(F.col("c") / shard).cast("int").alias("parts")))

    def placed(rows: DataFrame, split: Column, every: str, own: str, *more: Column) -> DataFrame:
        rows = rows.join(hot, "lead", "left")
        rows = rows.withColumn(every, F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        rows = rows.withColumn(own, F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(split, F.col("parts")).cast("int")))
        cold = F.col("parts").isNull()
        cell = [F.when(cold, F.lit("")).otherwise(F.col("lead")).alias("lead"), F.when(cold, F.pmod(F.xxhash64("lead"), F.lit(bins)).cast("int")).otherwise(F.col("bin")).alias("bin"), F.col("chunk")]
        return rows.select(*cell, *more)

    halves = placed(owners, F.xxhash64("word"), "chunk", "bin", F.lit(0).alias("role"), F.col("kind"), F.col("word"), F.col("n"))
    scanned = placed(probes, F.xxhash64("word", F.lit(1)), "bin", "chunk", F.lit(1).alias("role"), F.lit(0).alias("kind"), F.col("word"), F.lit(0).cast("long").alias("n"))
    cells = halves.unionByName(scanned).repartition("lead", "bin", "chunk").sortWithinPartitions("lead", "bin", "chunk", "role", "word")
    found = cells.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("x")
    found = materialize(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.w").alias("best")))
    discard(sizes)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): each word's last form. A form has ``TIMES`` the occurrences of its word, so steps are few and never turn back."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurs: int = OCCURS, damage: int = DAMAGE, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    Words are runs of letters of any length; null and empty texts have none. A row counts as often as it
    occurs; a null id hashes as an empty one. Of near words with equal counts the smallest in code-point
    order is the form. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = materialize(counts(docs, "id", "text", least, occurs, damage))
    near = near_words(words, shard)
    formed = F.col("best_n") >= F.col("n") * times
    rows = words.join(near, "word", "left").withColumns({"form": F.when(formed, F.col("best")), "form_n": F.when(formed, F.col("best_n"))})
    rows = materialize(rows.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    last = roots(rows.where("form is not null").select("word", "form"))
    discard(words, near)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) t(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{LEAST},}}')) run FROM documents),
pairs AS (SELECT id, run, count(*) c, hex(encode(id || ':' || run)) x FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(x) // 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) h FROM pairs, crc),
cut AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) n FROM cut WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {OCCURS}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) s FROM (SELECT *, unnest(range(1, length(word) + 1)) i FROM words)),
near AS (SELECT l.word, w.word other, w.n FROM less l JOIN words w ON l.s = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.s = w.word UNION SELECT a.word, b.word, b.n FROM less a JOIN less b USING (i, s) WHERE a.word <> b.word),
best AS (SELECT word, count(*) n_near, min(struct_pack(m := -n, o := other)) b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) n_near, CASE WHEN -b.m >= {TIMES} * w.n THEN b.o END form, CASE WHEN -b.m >= {TIMES} * w.n THEN -b.m END form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word root, 0 step FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT max_by(root, step) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM formed f"""
