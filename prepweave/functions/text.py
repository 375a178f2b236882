"""Text functions as native columns, over Unicode white space and letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the four separator controls.
BLANK = r"[\s\x1c-\x1f]"
NULL_LIKE = ("", "null", "none", "n/a", "na", "-")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def normalise_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"(?U){BLANK}+", " "))


def proper_case(c: Column) -> Column:
    """A capital after every character that is no letter; other letters small."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def remove_non_printable(c: Column) -> Column:
    """Drops control, format, private and unassigned characters but tab and line feed."""
    return F.regexp_replace(c, r"[\p{C}&&[^\t\n]]", "")


def normalise_nulls(c: Column, values: tuple[str, ...] = NULL_LIKE) -> Column:
    return F.when(F.lower(trim(c)).isin([v.lower() for v in values]), None).otherwise(c)


def is_blank(c: Column) -> Column:
    return trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
