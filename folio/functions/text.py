"""Text functions on columns. Empty string stands for a missing value, as in the data model."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to each other, and limits of the name rules.
FOLD_FROM, FOLD_TO = "ÇĞİIÖŞÜçğıiöşül", "CGIIOSUCGIIOSUI"
MARKED, UNMARKED = "ÇĞİÖŞÜ", "CGIOSU"
CAPITALS = "A-ZÇĞİÖŞÜ"
NAME_LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"
NOTHING_READ = "YOK"
#: Unicode's white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _plain_letters() -> tuple[str, str]:
    """Letters and digits that Unicode decomposes into one of ASCII and marks, the dotless i besides."""
    pairs = {"ı": "i"}
    for ch in map(chr, range(0x80, 0x10000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


PLAIN_FROM, PLAIN_TO = _plain_letters()


def strip(s: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(s, F.lit(SPACES))


def turkish_upper(s: Column) -> Column:
    return F.upper(F.translate(s, "iı", "İI"))


def fold(s: Column) -> Column:
    """Capitals A-Z only; marks and the i, ı, l confusion folded away."""
    return F.regexp_replace(F.upper(F.translate(s, FOLD_FROM, FOLD_TO)), "[^A-Z]", "")


def normalize(s: Column) -> Column:
    """Turkish capitals and single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(turkish_upper(strip(s)), f"[^{CAPITALS} ]", ""), " +", " "))


def undot(s: Column) -> Column:
    return F.translate(s, "İ", "I")


def unmark(s: Column) -> Column:
    return F.translate(s, MARKED, UNMARKED)


def name_letters(s: Column) -> Column:
    """A name's letters and spaces, without the rest."""
    return strip(F.regexp_replace(s, f"[^{NAME_LETTERS} ]", ""))


def plausible_name(s: Column) -> Column:
    """One to four words, five characters or more once cleaned, three quarters of them letters (A-Z and Turkish ones) or spaces; false for null."""
    letters = F.regexp_replace(s, f"[^{NAME_LETTERS} ]", "")
    words = F.size(F.filter(F.split(letters, " "), lambda x: x != ""))
    return F.coalesce((s != "") & (F.length(letters) >= 0.75 * F.length(s)) & (F.length(strip(letters)) >= 5) & words.between(1, 4), F.lit(False))


def clean_reading(raw: Column) -> Column:
    """A reader's first line as a name; its word for nothing (YOK, as it stands) is empty."""
    line = strip(F.regexp_replace(F.split(strip(raw), "\n")[0], r"^[\s:\-]+", ""))
    return F.when(turkish_upper(line) == NOTHING_READ, F.lit("")).otherwise(normalize(line))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def digits_of(raw: Column, least: int, most: int) -> Column:
    """The digits of a reading's first line if their number fits, else empty."""
    found = only_digits(F.split(strip(raw), "\n")[0])
    return F.when(F.length(found).between(least, most), found).otherwise(F.lit(""))


def slug(s: Column) -> Column:
    """A file name of a-z, 0-9 and _: marks are dropped, and so are letters without a plain form (and signs that stand for several letters)."""
    plain = F.lower(F.translate(s, PLAIN_FROM, PLAIN_TO))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(plain), r"[\s_]+", "_"), "[^a-z0-9_]", ""), "^_+|_+$", "")


def person_key(s: Column) -> Column:
    return F.upper(slug(s))


def mask_id(s: Column) -> Column:
    return F.when(F.length(s) == 11, F.concat(F.substring(s, 1, 3), F.lit("…"), F.substring(s, 10, 2))).otherwise(s)


def id_valid(s: Column) -> Column:
    """Checksum of the eleven-digit id; false for anything else."""
    d = [F.ascii(F.substring(s, k, 1)) - 48 for k in range(1, 12)]
    tenth = F.pmod(7 * (d[0] + d[2] + d[4] + d[6] + d[8]) - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    last = F.pmod(sum(d[1:10], d[0]), F.lit(10))
    return F.coalesce(s.rlike("^[1-9][0-9]{10}$") & (tenth == d[9]) & (last == d[10]), F.lit(False))


def valid_ids(text: Column) -> Column:
    """Distinct checksum-valid ids of a text, whatever stands beside them."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"[ .\-]", ""), F.lit(r"(?U)\b([1-9][0-9]{10})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, id_valid))


def merge_spelling(read: Column, ocr: Column) -> Column:
    """Two spellings with the same folded letters: spaces of both, and the marked letter of either, the reading's first."""
    chars = lambda s: F.split(F.regexp_replace(s, " ", ""), "")
    marked = lambda c: unmark(c) != c
    letters = F.zip_with(chars(read), chars(ocr), lambda a, b: F.when(marked(a), a).when(marked(b), b).otherwise(a))
    before = lambda s: F.transform(F.split(s, " +"), lambda w, i: F.aggregate(F.slice(F.split(s, " +"), 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)))
    cuts = F.array_union(before(read), before(ocr))
    spaced = F.transform(letters, lambda c, i: F.concat(c, F.when(F.array_contains(cuts, i + 1) & (i + 1 < F.size(letters)), F.lit(" ")).otherwise(F.lit(""))))
    return F.array_join(spaced, "")


def short_duration(seconds: Column) -> Column:
    """Seconds as a short text: ~40 sn, ~3 dk, ~2 sa 5 dk; empty if null or not positive."""
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    text = F.when(seconds < 60, F.format_string("~%d sn", F.floor(seconds + 0.5).cast("long"))).when(minutes < 60, F.format_string("~%d dk", minutes))
    text = text.otherwise(F.format_string("~%d sa %d dk", F.floor(minutes / 60).cast("long"), minutes % 60))
    return F.when(seconds > 0, text).otherwise(F.lit(""))
