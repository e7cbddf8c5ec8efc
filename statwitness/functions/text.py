"""Column functions on text: trimming, case tests, number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from statwitness import params as P

NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def strip(c: Column) -> Column:
    """Trim every kind of white space on both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_list(c: Column) -> Column:
    """White-space separated words; empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def is_all_upper(c: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_all_lower(c: Column) -> Column:
    return (F.lower(c) == c) & (F.upper(c) != c)


def na_to_null(c: Column) -> Column:
    """Missing-value tokens become null; suppression markers are data and stay."""
    return F.when(~c.isin(P.NA_TOKENS), c)


def to_number(c: Column) -> Column:
    """Text to double; null when the text is not a plain number (``1d`` and ``NaN`` are not)."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def marker(c: Column) -> Column:
    """The suppression marker a cell holds, else null."""
    return F.when(c.isin(P.SUPPRESSION_MARKERS), c)


def cell(c: Column) -> Column:
    """A cell as (raw, num, marker); raw is never changed."""
    return F.struct(c.alias("raw"), to_number(c).alias("num"), marker(c).alias("marker"))


def any_pattern(c: Column, patterns: list[str]) -> Column:
    """True when one of the patterns matches from the start of the text."""
    return c.rlike("|".join(f"^(?:{p})" for p in patterns))


def plain_number(c: Column) -> Column:
    """Drop a trailing ``.0`` from a number's text so 95.0 shows as 95."""
    return F.regexp_replace(c.cast("string"), r"^([+-]?\d+)\.0+$", "$1")


def safe_id(c: Column) -> Column:
    """An identifier usable as a file name: blanks and slashes become underscores."""
    return F.regexp_replace(c, "[ /]", "_")
