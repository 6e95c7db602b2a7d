"""Log lines since a mark, and run-duration tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions.loglines import has_timestamp, line_timestamp


def stamped(lines: DataFrame) -> DataFrame:
    """Lines that carry a bracketed timestamp."""
    return lines.where(has_timestamp(F.col("line")))


def with_time(lines: DataFrame) -> DataFrame:
    """Lines with a readable time, as column ``ts``; the others are dropped."""
    return lines.withColumn("ts", line_timestamp(F.col("line"))).where(F.col("ts").isNotNull())


def _wall(mark: datetime | None) -> Column:
    """A wall-clock literal that no time zone shifts."""
    return F.lit(None if mark is None else mark.isoformat(sep=" ")).cast("timestamp_ntz")


def new_lines(lines: DataFrame, mark: datetime | None) -> DataFrame:
    """Lines strictly later than the mark; all of them when there is none yet."""
    timed = with_time(lines)
    return timed if mark is None else timed.where(F.col("ts") > _wall(mark))


def next_mark(lines: DataFrame, mark: datetime | None) -> DataFrame:
    """The mark after these lines: the latest time seen, never earlier than before."""
    return new_lines(lines, mark).agg(F.greatest(F.max("ts"), _wall(mark)).alias("mark"))


def duration_table(phases: DataFrame) -> DataFrame:
    """Every phase record, then a total row; no record gives no row at all."""
    exact = F.col("duration_sec").cast("decimal(18,6)")
    total = (
        phases.agg(F.count("*").alias("n"), F.sum(exact).cast("double").alias("duration_sec"))
        .where("n > 0")
        .select(
            F.lit("Total").alias("scope"), F.lit("").alias("component"), F.lit("").alias("identifier"),
            "duration_sec", F.lit(True).alias("is_total"),
        )
    )
    rows = phases.select("scope", "component", "identifier", "duration_sec", F.lit(False).alias("is_total"))
    return rows.unionByName(total)
