"""Running values along a sequence, computed in bounded pieces.

A window ordered over a whole table, or over one very long group, would run in a
single task. Here the rows are dealt by ranges of the sequence, whatever its numbers
look like; a window runs inside each range, and what crosses a border comes from a
second window over one summary row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lakesight.session import materialize


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows with ``_chunk``, the number of their range; written, so that every use sees the same ranges."""
    return materialize(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()), "ranges")


def carry_last(
    df: DataFrame, value: str, into: str, keys: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """The last non-NULL ``value`` on an earlier row of the same group; ``seq`` is unique in it."""
    rows = in_ranges(df, *keys, seq)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.last(value, ignorenulls=True).over(inside))

    ends = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("_c"),
        F.last("_end", ignorenulls=True).over(before).alias("_carried"),
    )
    return (
        local.join(carried, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_chunk") == F.col("_c")])
        .withColumn(into, F.coalesce("_local", "_carried"))
        .select(*df.columns, into)
    )


def failure_streaks(df: DataFrame, ok: str = "ok", seq: str = "seq") -> DataFrame:
    """Consecutive failures up to and including each row; 0 on a success."""
    rows = in_ranges(df, seq)
    inside = Window.partitionBy("_chunk").orderBy(seq)
    placed = rows.withColumn("_rn", F.row_number().over(inside))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_last_ok", F.max(F.when(F.col(ok), F.col("_rn"))).over(running))

    # Failures after the last success of a range, or all of its rows.
    tails = (
        placed.groupBy("_chunk")
        .agg(F.max("_rn").alias("_n"), F.max(F.when(F.col(ok), F.col("_rn"))).alias("_ok_rn"))
        .withColumn("_tail", F.col("_n") - F.coalesce("_ok_rn", F.lit(0)))
        .withColumn("_has_ok", F.col("_ok_rn").isNotNull())
    )
    # One row per range from here on, as many as there are partitions.
    order = Window.orderBy("_chunk")
    islands = tails.withColumn("_island", F.sum(F.col("_has_ok").cast("int")).over(order))
    out = Window.partitionBy("_island").orderBy("_chunk")
    carried = islands.withColumn("_out", F.sum("_tail").over(out)).select(
        "_chunk", F.coalesce(F.lag("_out").over(order), F.lit(0)).alias("_in")
    )
    streak = F.when(F.col("_last_ok").isNotNull(), F.col("_rn") - F.col("_last_ok")).otherwise(
        F.col("_rn") + F.col("_in")
    )
    return local.join(carried, "_chunk").withColumn("streak", streak.cast("long")).select(*df.columns, "streak")


def abort_point(streaks: DataFrame, limit: int = 10, seq: str = "seq") -> DataFrame:
    """Where a load stops: the first row that completes ``limit`` failures in a row."""
    return streaks.where(F.col("streak") >= limit).agg(F.min(seq).alias("abort_seq"))
