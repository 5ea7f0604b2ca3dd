"""License scans by diagonal voting, in DataFrame operations only.

Templates are short texts with a label. Each ``k`` words in a row of a text that also
stand in a template are a vote for the diagonal (text position less template position) on
which they lie. A place that is off by a few words spreads over neighbouring diagonals, so
the votes of diagonals within ``gap`` of each other are merged. What has enough votes is
verified on the words themselves: a template of m words is found where a span of the text
differs from it in at most m / ``ALLOWED`` words (inserted, deleted or replaced) and holds
every word that the template must have, such as a version. Phrases, the templates of the
base, have to stand there word by word.

A template of fewer than ``SHORT`` words is looked up by two words, others by three: a
span with that many differing words still has a vote then, so none is missed. To compare
spans in words and not in letters, each word of a template has a sign of its own, and words
that it doesn't have are blanks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, materialize
from folio.llm.decontaminate import KEY, _beside, keyed, with_grams, words

ALLOWED, SHORT = 5, 6


@dataclass(frozen=True)
class Template:
    """Lower-case words with a label; ``must`` are words that no span may lack, and a phrase allows no difference."""

    label: str
    words: tuple[str, ...]
    must: tuple[str, ...] = ()
    phrase: bool = False

    @property
    def k(self) -> int:
        return 2 if len(self.words) < SHORT else 3

    @property
    def allowed(self) -> int:
        return 0 if self.phrase else len(self.words) // ALLOWED

    @property
    def votes(self) -> int:
        """As many are left of all its grams if ``allowed`` words differ."""
        return max(1, len(self.words) - self.k + 1 - self.k * self.allowed)

    @property
    def signs(self) -> dict[str, str]:
        return {w: chr(0x21 + i) if i < 94 else chr(0x100 + i) for i, w in enumerate(dict.fromkeys(self.words))}


def template(label: str, text: str, must: str = "", phrase: bool = False) -> Template:
    return Template(label, tuple(text.split()), tuple(must.split()), phrase)


#: The phrases of the base, and the wording of common public licenses and notices, in words as ``words`` cuts them.
PHRASES = [
    template("cc-by", "cc by", phrase=True),
    template("gpl", "general public license", phrase=True),
    template("reserved", "all rights reserved", phrase=True),
]
NOTICES = [
    template("mit", "released under the mit license", "mit"),
    template("mit", "licensed under the mit license", "mit"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache 2 0"),
    template("apache-2.0", "you may not use this file except in compliance with the license"),
    template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public 2"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public 3"),
    template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    template("bsd", "licensed under the bsd license", "bsd"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public 2 0"),
    template("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    template("cc-by-4.0", "cc by 4 0", "cc by 4 0"),
    template("cc-by-sa-4.0", "cc by sa 4 0", "cc by sa 4 0"),
    template("cc0-1.0", "dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    template("reserved", "all rights reserved no part of this work may be reproduced without permission", "reserved"),
]
TEMPLATES = PHRASES + NOTICES


def _grams(df: DataFrame) -> DataFrame:
    """df with arrays g2 and g3, a hash for each two and each three words in a row of w."""
    return with_grams(df, "g2", 2).withColumn("g3", _beside("g2", 1, lambda a, b: F.xxhash64(a, b)))


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(g2, g3, t, q): every gram of the templates and its position; g3 is null for those looked up by two words."""
    if short := [x for x in templates if len(x.words) < 2]:
        raise ValueError(f"templates need two words: {short}")
    table = spark.createDataFrame([(t, x.k, list(x.words)) for t, x in enumerate(templates)], "t int, k int, w array<string>")
    grams = _grams(table).select("t", "k", F.posexplode(F.arrays_zip("g2", "g3")).alias("q", "x"))
    return grams.where("k = 2 or x.g3 is not null").select("t", "q", "x.g2", F.when(F.col("k") == 3, F.col("x.g3")).alias("g3"))


def diagonals(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(k1, k2, t, d, votes): the votes of each diagonal of each text, from rows (k1, k2, w)."""
    grams = F.broadcast(template_grams(docs.sparkSession, templates)).withColumnsRenamed({"g2": "h2", "g3": "h3"})  # as many rows as the templates have words
    at = _grams(docs).select(*KEY, F.posexplode_outer(F.arrays_zip("g2", "g3")).alias("pos", "x")).where("pos is not null")
    at = at.select(*KEY, "pos", "x.g2", "x.g3")
    hits = at.join(grams, (F.col("g2") == F.col("h2")) & (F.col("h3").isNull() | (F.col("g3") == F.col("h3"))))
    found = hits.groupBy(*KEY, "t", (F.col("pos") - F.col("q")).alias("d")).agg(F.collect_set("pos").alias("at"))  # a template's length at most
    return found.select(*KEY, "t", "d", F.size("at").cast("long").alias("votes"))


def _of(templates: list[Template], t: Column, what) -> Column:
    return F.element_at(F.array(*(what(x) for x in templates)), t + 1)


def candidates(found: DataFrame, templates: list[Template]) -> DataFrame:
    """(k1, k2, places): for each text its diagonals with enough votes, as structs (t, d)."""
    gap = max((x.allowed for x in templates), default=0)
    merged = F.sum("votes").over(Window.partitionBy(*KEY, "t").orderBy("d").rangeBetween(-gap, gap))
    enough = lambda x: F.lit(len(x.words) - x.k + 1 if x.phrase else x.votes)
    votes = F.when(_of(templates, F.col("t"), lambda x: F.lit(x.phrase)), F.col("votes")).otherwise(F.col("merged"))
    return found.withColumn("merged", merged).where(votes >= _of(templates, F.col("t"), enough)).groupBy(*KEY).agg(F.collect_list(F.struct("t", "d")).alias("places"))


def _verified(w: Column, places: Column, templates: list[Template]) -> Column:
    """Structs (base, label, at, score) of the places near which a span's words are near enough to their template's."""
    of = lambda t, what: _of(templates, t, what)

    def coded(x: Column) -> Column:
        """x with the words around it as signs, s, and where they start."""
        t, start = x["t"], F.greatest(x["d"] - of(x["t"], lambda y: F.lit(y.allowed)), F.lit(0))
        end = x["d"] + of(t, lambda y: F.lit(len(y.words) + y.allowed))
        signs = of(t, lambda y: F.create_map(*(F.lit(z) for pair in y.signs.items() for z in pair)))
        s = F.array_join(F.transform(F.slice(w, start + 1, F.greatest(end - start, F.lit(0))), lambda y: F.coalesce(F.try_element_at(signs, y), F.lit(" "))), "")
        return F.struct(t.alias("t"), x["d"].alias("d"), (x["d"] - start).alias("by"), s.alias("s"))

    def judged(x: Column) -> Column:
        """The fewest words in which a span that starts and ends up to ``allowed`` words off differs."""
        t, allowed = x["t"], of(x["t"], lambda y: F.lit(y.allowed))
        own = of(t, lambda y: F.lit("".join(y.signs[z] for z in y.words)))
        must = of(t, lambda y: F.array(*(F.lit(y.signs[z]) for z in y.must)).cast("array<string>"))

        def differing(a: Column, b: Column) -> Column:
            start, end = x["by"] + a, x["by"] + F.length(own) + b
            span = F.substring(x["s"], start + 1, end - start)
            return F.when((start >= 0) & (end <= F.length(x["s"])) & F.forall(must, lambda y: F.contains(span, y)), F.levenshtein(own, span))

        shifts = F.sequence(-allowed, allowed)
        off = F.array_min(F.transform(shifts, lambda a: F.array_min(F.transform(shifts, lambda b: differing(a, b)))))
        return F.struct(t.alias("t"), x["d"].cast("long").alias("at"), off.alias("off"))

    kept = F.filter(F.transform(F.transform(places, coded), judged), lambda x: x["off"] <= of(x["t"], lambda y: F.lit(y.allowed)))
    score = lambda x: F.lit(1.0) - x["off"] / of(x["t"], lambda y: F.lit(float(len(y.words))))
    base, label = lambda y: F.lit(y.phrase), lambda y: F.lit(y.label)
    return F.transform(kept, lambda x: F.struct(of(x["t"], base).alias("base"), of(x["t"], label).alias("label"), x["at"].alias("at"), score(x).alias("score")))


def spans(docs: DataFrame, templates: list[Template] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """docs with n_words and found, the verified places of each text as structs (base, label, at, score); other columns stay."""
    docs = keyed(docs, text_col)
    found = materialize(candidates(diagonals(docs.select(*KEY, words(F.col(text_col)).alias("w")), templates), templates))
    few = found.agg(F.sum(F.size("places"))).first()[0] or 0
    rows = docs.withColumn("w", words(F.col(text_col))).join(F.broadcast(found) if few <= BROADCAST_ROWS else found, KEY, "left")
    none = F.expr("cast(array() as array<struct<base: boolean, label: string, at: bigint, score: double>>)")
    return rows.withColumns({"n_words": F.size("w").cast("long"), "found": F.coalesce(_verified(F.col("w"), F.col("places"), templates), none)}).drop(*KEY, "w", "places")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document.

    n_base counts every place of every phrase, overlapping ones too; first_word and last_word
    are its places' least and largest start. labels also has what the notices found. score is
    the likeness of the best place, 1 if a template stands there word by word, 0 if none does.
    Null and empty texts have no words and no labels; labels that tie are all listed, each once. Every row is a document of
    its own: ids may be null or repeat, and copies of a text get the same labels. Texts of any
    length are read whole. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = spans(docs, templates)
    base = F.filter("found", lambda x: x["base"])
    listed = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["at"])
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def sql(templates: list[Template] = TEMPLATES) -> str:
    """DuckDB SQL of ``scan`` over documents; templates may have 94 different words each."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    known = ", ".join(
        f"({t}, '{x.label}', {x.phrase}, {x.k}, {len(x.words)}, {x.allowed}, {x.votes}, {quoted(x.words)}, {quoted(x.must)}, {quoted(x.signs)})" for t, x in enumerate(templates)
    )
    gap = max(x.allowed for x in templates)
    coded = lambda words: f"array_to_string(list_transform({words}, lambda x: coalesce(chr(32 + CAST(list_position(signs, x) AS INT)), ' ')), '')"
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
tm(t, label, base, k, m, e, need, tw, must, signs) AS (VALUES {known}),
tg AS (SELECT t, i - 1 q, tw[i] a, tw[i + 1] b, CASE WHEN k = 3 THEN tw[i + 2] END c FROM (SELECT *, unnest(range(1, m - k + 2)) i FROM tm)),
x AS (SELECT r, unnest(w) a, generate_subscripts(w, 1) - 1 pos FROM d), y AS (SELECT *, lead(a) OVER s b, lead(a, 2) OVER s c FROM x WINDOW s AS (PARTITION BY r ORDER BY pos)),
h AS (SELECT r, t, pos, pos - q dg FROM y JOIN tg ON y.a = tg.a AND y.b = tg.b AND (tg.c IS NULL OR y.c = tg.c)),
g AS (SELECT r, t, dg, count(*) votes FROM h GROUP BY ALL),
n AS (SELECT *, sum(votes) OVER (PARTITION BY r, t ORDER BY dg RANGE BETWEEN {gap} PRECEDING AND {gap} FOLLOWING) al FROM g),
c AS (SELECT r, dg, label, base, m, e, tw, must, signs, w, unnest(range(-e, e + 1)) a0 FROM n JOIN tm USING (t) JOIN d USING (r) WHERE CASE WHEN base THEN votes = m - k + 1 ELSE al >= need END),
c2 AS (SELECT * REPLACE (dg + a0 AS a0), dg + m + unnest(range(-e, e + 1)) b0 FROM c),
v AS (SELECT r, dg, label, base, m, e, min(levenshtein({coded('tw')}, {coded('w[a0 + 1:b0]')})) o FROM c2 WHERE a0 >= 0 AND b0 <= len(w) AND b0 >= a0 AND list_has_all(w[a0 + 1:b0], must) GROUP BY ALL),
f AS (SELECT r, count(*) FILTER (base) n_base, min(dg) FILTER (base) fw, max(dg) FILTER (base) lw, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') bl, string_agg(DISTINCT label, ',' ORDER BY label) al, max(1.0::DOUBLE - o / m::DOUBLE) s FROM v WHERE o <= e GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_base, 0) n_base, CAST(fw AS BIGINT) first_word, CAST(lw AS BIGINT) last_word, coalesce(bl, '') base_labels, coalesce(al, '') labels, coalesce(s, 0) score FROM d LEFT JOIN f USING (r)"""
