"""Layout rules over positioned words (doc_id, page_no, word_no, x0, y0, x1, y1, word).

word_no is unique on a page and settles ties. Words with a null coordinate are on no line; null words have no letters.
Pages without words have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import fold

# labels' folded spelling, the stems of an official's role, and distances in points.
OFFICIAL_STEMS = ("VEZNEDAR", "MEMUR", "YETKILI", "IMZA", "MUDUR", "MUDURLUGU", "SEKRETER", "BASKAN", "TASDIK", "ONAY", "KATIP")
NAME_LABEL, ID_LABEL, SPARE_LABEL = "ADISOYADI", "TCKIMLIKNO", "SOYADI"
EDITS, WORDS, GAP, VALUE_SLACK = 2, 4, 25.0, 0.5
BLOCK_HEIGHT, BLOCK_GAP = 65.0, 120.0
ON_PAGE = ["doc_id", "page_no"]


#: Height in points of the bands that words meet in.
BAND = 24.0


def _inside(x, y):
    """The middle of box x lies inside the height of box y."""
    middle = (x["y0"] + x["y1"]) / 2
    return (y["y0"] < middle) & (middle < y["y1"])


def same_line(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of words on one line: the middle of one box lies inside the other's height.

    Words are dealt once, to the bands of the page that their height reaches into; a word's middle meets the words of its band. A
    word without height is on no line. Words with a null coordinate have no pairs.
    """
    band = lambda y: F.floor(y / BAND)
    word = F.struct("word_no", "x0", "y0", "x1", "y1", "word")
    reach = F.explode(F.sequence(band(F.col("y0")), band(F.col("y1")))).alias("band")
    rows = words.where("y0 <= y1").select(*ON_PAGE, band((F.col("y0") + F.col("y1")) / 2).alias("own"), word.alias("w"), reach)
    bands = rows.groupBy(*ON_PAGE, "band").agg(F.collect_list(F.struct((F.col("own") == F.col("band")).alias("here"), "w")).alias("ws"))
    points = bands.select(*ON_PAGE, "ws", F.explode("ws").alias("p")).where("p.here")
    met = points.select(*ON_PAGE, F.col("p.w").alias("p"), F.explode("ws").alias("q")).select(*ON_PAGE, "p", F.col("q.w").alias("q")).where(_inside(F.col("p"), F.col("q")))
    both = F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.when(~_inside(F.col("q"), F.col("p")), F.struct(F.col("q").alias("a"), F.col("p").alias("b"))))
    return met.select(*ON_PAGE, F.explode(both).alias("x")).where("x is not null").select(*ON_PAGE, "x.a", "x.b")


def lines(words: DataFrame, stems: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_no, seed, line, roles): the words on one line with any word of the page, from left to right; seed numbers the lines in order of their first word_no.

    A page's words meet in one row, each with its folded letters; words of equal height and place have one line between them. roles has the page's words that hold one of the stems.
    """
    c = F.col
    word = F.struct("x0", "word_no", "y0", "x1", "y1", "word", "letters", ((c("y0") + c("y1")) / 2).alias("middle"))
    role = F.when(c("letters").rlike("|".join(stems)) if stems else F.lit(False), F.struct("x0", "x1", "y0"))
    folded = words.withColumn("letters", fold(c("word")))
    pages = folded.groupBy(*ON_PAGE).agg(F.array_sort(F.collect_list(F.when(c("y0") <= c("y1"), word))).alias("ws"), F.collect_list(role).alias("roles"))
    order = F.array_sort(F.transform("ws", lambda w: F.struct(w["word_no"], w["y0"].alias("y0"), w["y1"].alias("y1"), w["middle"].alias("middle"))))
    places = F.array_distinct(F.transform(order, lambda w: F.struct(w["y0"].alias("y0"), w["y1"].alias("y1"), w["middle"].alias("middle"))))
    holds = lambda x, y: (x["y0"] < y["middle"]) & (y["middle"] < x["y1"])
    found = F.transform(places, lambda p: F.filter("ws", lambda q: holds(p, q) | holds(q, p)))
    return pages.select(*ON_PAGE, "roles", F.posexplode_outer(found).alias("seed", "line")).where(F.size("line") > 0)


def windows(words: DataFrame, labels: tuple[str, ...], edits: int = EDITS, stems: tuple[str, ...] = ()) -> DataFrame:
    """Runs of one to four words of each line whose folded text is near one of the labels."""
    text = lambda i, n: F.array_join(F.transform(F.slice("line", i, n), lambda x: x["letters"]), "")
    size = F.size("line")
    starts = F.transform("line", lambda _, k: F.transform(F.sequence(F.lit(1), F.least(F.lit(WORDS), size - k)), lambda n: F.struct((k + 1).alias("i"), n.alias("n"), text(k + 1, n).alias("text"))))
    spelled = F.transform(F.flatten(starts), lambda w: F.struct(w["i"].alias("i"), w["n"].alias("n"), F.length(w["text"]).alias("letters"), *(F.levenshtein(w["text"], F.lit(label), edits).alias(label) for label in labels)))
    near = F.filter(spelled, lambda w: F.greatest(F.lit(-1), *(w[label] for label in labels)) >= 0)
    runs = lines(words, stems).select(*ON_PAGE, "seed", "line", "roles", F.explode_outer(near).alias("w")).where("w is not null")
    each = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"w.{label}").alias("distance")) for label in labels))).alias("d")
    runs = runs.select(*ON_PAGE, "seed", "line", "roles", "w.i", "w.n", "w.letters", each).where("d.distance >= 0").withColumn("run", F.slice("line", F.col("i"), F.col("n")))
    run = F.col("run")
    return runs.select(*ON_PAGE, "seed", "line", "roles", "i", "n", "letters", "d.label", "d.distance", run[0]["x0"].alias("x0"), F.array_min(F.transform(run, lambda x: x["y0"])).alias("y0"), F.array_max(F.transform(run, lambda x: x["x1"])).alias("x1"), F.array_max(F.transform(run, lambda x: x["y1"])).alias("y1"))


def labelled_values(words: DataFrame, labels: tuple[str, ...], edits: int = EDITS) -> DataFrame:
    """(doc_id, page_no, label, value, box) right of each label; of a page's lines the first that has a value. The box is that of the value's words.

    The best window is the nearest spelling, then the most letters, then the one that ends
    first. Its value runs to the right until a gap of more than a column's.
    """
    best = windows(words, labels, edits).withColumn("r", F.row_number().over(Window.partitionBy(*ON_PAGE, "seed", "label").orderBy("distance", F.desc("letters"), "x1"))).where("r = 1")
    right = F.filter("line", lambda x: x["x0"] >= F.col("x1") - VALUE_SLACK)
    first_gap = F.array_min(F.filter(F.transform("right", lambda x, k: F.when((k > 0) & (x["x0"] - F.col("right")[F.greatest(k - 1, F.lit(0))]["x1"] > GAP), k)), lambda k: k.isNotNull()))
    kept = F.slice("right", 1, F.coalesce(first_gap, F.size("right")))
    found = best.withColumn("right", right).where(F.size("right") > 0).withColumn("kept", kept)
    found = found.withColumn("value", F.regexp_replace(F.array_join(F.transform("kept", lambda x: x["word"]), " "), "^[: ]+", "")).where("value <> ''")
    one = found.groupBy(*ON_PAGE, "label").agg(F.min_by(F.struct("value", *(pick(f"kept.{c}").alias(c) for c, pick in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max)))), "seed").alias("f"))
    return one.select(*ON_PAGE, "label", "f.value", F.struct("f.x0", "f.y0", "f.x1", "f.y1").alias("box"))


def label_values(words: DataFrame, label: str, edits: int = EDITS) -> DataFrame:
    """(doc_id, page_no, value, box) of ``labelled_values`` for one label."""
    return labelled_values(words, (label,), edits).drop("label")


def labelled_boxes(words: DataFrame, labels: tuple[str, ...], stems: tuple[str, ...] = OFFICIAL_STEMS, edits: int = EDITS) -> DataFrame:
    """Each label's own box on each page: starts with a capital, not inside an official's block; topmost, then nearest, then most letters, then first.

    A block is an official's if a word that holds one of the stems begins between ``BLOCK_HEIGHT`` above the label's top and as
    much below its bottom, with at most ``BLOCK_GAP`` between them to the side.
    """
    c = F.col
    first = F.regexp_replace(F.element_at(c("line"), c("i"))["word"], r"^[.:\-–( ]+", "")
    gap = lambda r: F.greatest(r["x0"] - c("x1"), c("x0") - r["x1"], F.lit(0.0))
    inside = F.exists("roles", lambda r: r["y0"].between(c("y0") - BLOCK_HEIGHT, c("y1") + BLOCK_HEIGHT) & (gap(r) <= BLOCK_GAP))
    found = windows(words, labels, edits, stems).where(first.rlike(r"^\p{Lu}") & ~F.coalesce(inside, F.lit(False)))
    return found.groupBy(*ON_PAGE, "label").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), F.struct("y0", "distance", -c("letters"), "seed", "i", "n")).alias("b")).select(*ON_PAGE, "label", "b.*")


def label_boxes(words: DataFrame, label: str, stems: tuple[str, ...] = OFFICIAL_STEMS, edits: int = EDITS) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1) of ``labelled_boxes`` for one label."""
    return labelled_boxes(words, (label,), stems, edits).drop("label")


def line_box(x0, y0, y1, page_width, pad: float = 0.6):
    """The label's line to the page's right edge, padded by a share of its height."""
    return F.struct(F.greatest(x0 - 2, F.lit(0.0)).alias("x0"), (y0 - pad * (y1 - y0)).alias("y0"), page_width.alias("x1"), (y1 + pad * (y1 - y0)).alias("y1"))


def padded_box(x0, y0, x1, y1, page_width, page_height, pad: float = 6.0):
    """A region to cut out of the page: the box with a margin, inside the page."""
    return F.struct(F.greatest(x0 - pad, F.lit(0.0)).alias("x0"), F.greatest(y0 - pad, F.lit(0.0)).alias("y0"), F.least(x1 + pad, page_width).alias("x1"), F.least(y1 + pad, page_height).alias("y1"))


def top_strip(page_width, page_height, share: float = 0.22):
    """The upper part of a page, where a number stands that no word leads to."""
    return F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), page_width.alias("x1"), (page_height * share).alias("y1"))
