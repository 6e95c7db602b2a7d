"""Small text helpers shared by the other expression modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Drop white space, line breaks included, from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def any_of(words: list[str]) -> str:
    """A regular expression matching any of the words literally."""
    special = set(r"\.^$|?*+()[]{}-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, or NULL where the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def truncate(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters ending in an ellipsis; 0 or less keeps all."""
    if limit <= 0:
        return c
    if limit >= 3:
        kept = F.substring(c, 1, limit - 3)
    else:
        kept = F.expr("''") if limit == 3 else F.left(c, F.greatest(F.length(c) + (limit - 3), F.lit(0)))
    return F.when(F.length(c) > limit, F.concat(kept, F.lit("..."))).otherwise(c)


def last_segment(c: Column, separator: str) -> Column:
    return F.substring_index(c, separator, -1)
