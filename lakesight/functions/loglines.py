"""Log lines that carry a bracketed timestamp, and counts announced in them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BRACKETED_TIME = r"\[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)[^\]]*\]"


def has_timestamp(line: Column) -> Column:
    return line.rlike(BRACKETED_TIME)


def line_timestamp(line: Column) -> Column:
    """Wall-clock time of the line (zone suffix ignored), NULL when there is none."""
    text = F.substring(F.regexp_extract(line, BRACKETED_TIME, 1), 1, 26)
    return F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz")


def announced_count(line: Column, label: str) -> Column:
    """The number in ``<label>_COUNT=<n>``, or NULL."""
    return F.regexp_extract(line, rf"{label}_COUNT=(\d+)", 1).try_cast("long")
