"""Language ID by known words first, and by ever shorter character n-grams for the rest.

A word that the training texts hold scores by its frequency in each language. Of another
word the n-grams of ``LONGEST`` characters count, and where none of those is known the
ones shorter by one, down to single characters. A text's score in a language is the mean
of its words' scores, which are negative logs of relative frequencies; what a language
lacks costs ``PENALTY``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches

LONGEST, PENALTY = 5, 8.0
#: Texts of each language that are learned from (on average; chosen by a hash of the id), the bound of the fit.
TRAIN_TEXTS = 400
#: Words that a task remembers the scores of, and by how many words a score's certainty grows at most.
CACHE, CERTAIN_WORDS = 300_000, 50
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; numerals like ½ or Ⅷ aren't letters."""
    found = WORD.findall((text or "").lower())
    if found and not "".join(found).isalpha():
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    word_scores: np.ndarray
    gram_scores: list[np.ndarray]


def _counted(batches):
    """Counts of words (n = 0) and n-grams by language, summed over each batch."""
    for pdf in batches:
        counts: dict[tuple[str, int, str], int] = {}
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            for word in words_of(text):
                key = (lang, 0, word)
                counts[key] = counts.get(key, 0) + 1
        for (lang, _, word), c in list(counts.items()):
            padded = f" {word} "
            for n in range(1, LONGEST + 1):
                for i in range(len(padded) - n + 1):
                    key = (lang, n, padded[i : i + n])
                    counts[key] = counts.get(key, 0) + c
        yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["lang", "n", "gram", "c"])


def is_held_out(id_col):
    return F.crc32(id_col.cast("string")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TRAIN_TEXTS) -> Model:
    """Learn from texts with a language whose id isn't held out; a null id counts as not held out.

    At most about ``texts`` of each language are read, so the counts, which come to the
    driver, are bounded by that number and not by the input. Counts of 1 are left out for
    words and for n-grams longer than two.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(is_held_out(F.col("id")), F.lit(False)))
    per_lang = known.groupBy("lang").count().withColumn("share", F.lit(float(texts)) / F.col("count")).select("lang", "share")
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.join(F.broadcast(per_lang), "lang").where(draw < F.col("share")).select("lang", "text")  # a row for each language
    counts = rows.mapInPandas(_counted, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).where("c > 1 or (n > 0 and n < 3)").toArrow().to_pandas()
    return _model(counts)


def _model(counts: pd.DataFrame) -> Model:
    langs = sorted(counts["lang"].unique())
    at = {x: k for k, x in enumerate(langs)}
    tables, scores = [], []
    for n in range(LONGEST + 1):
        own = counts[counts["n"] == n].sort_values(["gram", "lang"])
        total = own.groupby("lang")["c"].sum()
        table: dict[str, int] = {}
        rows = [table.setdefault(g, len(table)) for g in own["gram"]]
        score = np.full((len(table), len(langs)), PENALTY)
        if rows:
            score[rows, [at[x] for x in own["lang"]]] = np.minimum(PENALTY, -np.log10(own["c"].to_numpy() / own["lang"].map(total).to_numpy()))
        tables.append(table)
        scores.append(score)
    return Model(langs, tables[0], tables[1:], scores[0], scores[1:])


class Scorer:
    """Scores texts; remembers the scores of words that the model lacks."""

    def __init__(self, model: Model):
        self.m, self.base = model, len(model.words)
        self._clear()

    def _clear(self):
        self.at = dict(self.m.words)
        self.table = np.vstack([self.m.word_scores.reshape(self.base, len(self.m.langs)), np.empty((CACHE, len(self.m.langs)))])

    def _backed_off(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            padded = f" {word} " if n > 1 else word  # a space alone tells nothing
            get = self.m.grams[n - 1].get
            known = [k for i in range(len(padded) - n + 1) if (k := get(padded[i : i + n])) is not None]
            if known:
                return self.m.gram_scores[n - 1][known].mean(axis=0)
        return np.full(len(self.m.langs), PENALTY)

    def _rows(self, words: list[str]) -> list[int]:
        rows = list(map(self.at.get, words))
        if None in rows:
            for k, row in enumerate(rows):
                if row is None:
                    row = self.at.get(words[k])
                    if row is None:
                        row = self.at[words[k]] = len(self.at)
                        self.table[row] = self._backed_off(words[k])
                    rows[k] = row
        return rows

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.m.langs:
            return "und", 0.0
        total = np.zeros(len(self.m.langs))
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            if len(self.at) + len(part) > len(self.table):
                self._clear()
            total += self.table[self._rows(part)].sum(axis=0)
        mean = total / len(words)
        odds = np.exp((mean.min() - mean) * math.log(10) * min(len(words), CERTAIN_WORDS))
        best = int(mean.argmin())
        return self.m.langs[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, held_out, lang_pred and score of each row, and the columns ``keep``.

    Null and empty texts and texts without a letter are ``und`` with score 0; equal scores
    go to the language that sorts first. Texts of any length are scored whole. Ids may be null
    (held_out is then null); rows that repeat an id or a text come back as often. Columns that
    aren't named are ignored; an empty table gives no rows, and a model of no texts says ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        score = Scorer(shared.value)
        for pdf in batches:
            found = [score(x) for x in pdf["_text"]]
            pdf["lang_pred"], pdf["score"] = [x[0] for x in found], [x[1] for x in found]
            yield pdf if kept_text else pdf.drop(columns="_text")

    keep = keep or []
    kept_text = text_col in keep
    rest = [c for c in keep if c != text_col]
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias(id_col), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"), *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text" or kept_text) + ", lang_pred string, score double"
    return rows.mapInPandas(scored, schema).withColumnsRenamed({"_text": text_col} if kept_text else {})
