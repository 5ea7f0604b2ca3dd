"""Registry numbers: candidates for detection, and the decision for extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three patterns of a registry number. An eleven-digit id that starts with 321 is no province number with a misread stroke.
DN = r"DN[\s:.\-]*(\d{4,6})"
PROVINCE = r"\b(?!\d{11}\b)32\s*[/1|]\s*(\d{4,6})"
LABEL = r"(?iu)Sicil\s+No\s*:?\s*(\d{4,5})"


def _numbers(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.length(x).between(4, 5)))


def drop_prefixes(numbers: Column) -> Column:
    """Numbers that aren't the start of another one."""
    return F.filter(numbers, lambda x: ~F.exists(numbers, lambda y: (y != x) & F.startswith(y, x)))


def candidates(text: Column) -> Column:
    """All numbers of a document, to see whether it mixes people."""
    return drop_prefixes(F.array_union(F.array_union(_numbers(text, DN), _numbers(text, PROVINCE)), _numbers(text, LABEL)))


def decision(text: Column) -> Column:
    """struct(value, warning): a number is taken only if nothing speaks against it.

    Both patterns agreeing on one five-digit number gives it. Disagreement, a lone
    four-digit number, several numbers or none give the empty string and say why.
    """
    every = drop_prefixes(F.array_union(_numbers(text, DN), _numbers(text, PROVINCE)))
    dn, province = F.array_intersect(_numbers(text, DN), every), F.array_intersect(_numbers(text, PROVINCE), every)
    both = F.array_intersect(dn, province)
    one = F.when(F.size(dn) > 0, dn).otherwise(province)
    out = lambda value, warning: F.struct(value.alias("value"), F.lit(warning).alias("warning"))
    none = F.lit("")
    return (
        F.when((F.size(both) == 1) & (F.length(both[0]) == 5), out(both[0], ""))
        .when(F.size(both) == 1, out(none, "four digits"))
        .when((F.size(dn) > 0) & (F.size(province) > 0) & (F.size(both) == 0), out(none, "sources differ"))
        .when((F.size(both) == 0) & (F.size(one) == 1) & (F.length(one[0]) == 5), out(one[0], "one source"))
        .when((F.size(both) == 0) & (F.size(one) == 1), out(none, "four digits"))
        .when(F.size(one) == 0, out(none, "not found"))
        .otherwise(out(none, "several"))
    )
