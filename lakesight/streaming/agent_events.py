"""Agent events as a stream: one state per query, closed sessions, and metrics per window.

The folds are built-in aggregations: events are combined per query where they are
read, so a query with very many events sends one row per task through the shuffle.
The same functions accept a finished table and then give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakesight.operators.trace import COMPLETE, ERROR, SYNTHESIS, TOOL_CALL, fold_metrics, metric_key, metric_parts
from lakesight.schema import TRACE

QUESTION = "question"
LATE = "10 minutes"
TIMEOUT = "30 minutes"


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Trace events from JSON files as they arrive."""
    reader = spark.readStream.schema(TRACE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _state_parts() -> list[Column]:
    """Counts and last values, mergeable; the calls themselves stay in the event table.

    A last value travels with its sequence number. A repeated terminal event replaces the
    answer, and arrival order does not matter, because the highest number decides.
    """
    kind, seq = F.col("event_type"), F.col("seq")
    call = (kind == TOOL_CALL) & ~F.col("tool").eqNullSafe(F.lit(SYNTHESIS))
    last = lambda c, event: F.max(F.when(kind == event, F.struct(seq.alias("seq"), c.alias("value"))))
    return [
        last(F.col("question"), QUESTION).alias("question"),
        F.count_if(call).alias("calls"),
        last(F.col("iteration").cast("long"), COMPLETE).alias("iterations"),
        last(F.col("execution_time_ms"), COMPLETE).alias("execution_time_ms"),
        last(F.col("answer"), COMPLETE).alias("answer"),
        last(F.col("error"), ERROR).alias("error"),
        F.max(F.when(kind == COMPLETE, F.lit(2)).when(kind == ERROR, F.lit(1)).otherwise(0)).alias("_end"),
        F.max("ts").alias("last_ts"),
    ]


LAST_VALUES = ["question", "iterations", "execution_time_ms", "answer", "error"]


def _with_status(states: DataFrame, unfinished: str) -> DataFrame:
    status = F.when(F.col("_end") == 2, "complete").when(F.col("_end") == 1, "error").otherwise(unfinished)
    values = {c: F.col(c)["value"] for c in LAST_VALUES}
    return states.withColumns({**values, "status": status}).drop("_end")


def state_parts(events: DataFrame, window: str = "1 day", late: str = LATE) -> DataFrame:
    """Parts of each query's state per window, written again whenever they change (update mode).

    A part is forgotten once its window has passed, so the stream's state is bounded by
    the queries of a window; :func:`query_states` folds the parts that were kept.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    parts = timed.groupBy("query_id", F.window("ts", window).alias("w")).agg(*_state_parts())
    return parts.withColumn("window_start", F.col("w.start")).drop("w")


def query_states(parts: DataFrame) -> DataFrame:
    """The current state of every query out of its parts."""
    folds = {**{c: F.max(c) for c in LAST_VALUES}, "calls": F.sum("calls"), "_end": F.max("_end"), "last_ts": F.max("last_ts")}
    states = parts.groupBy("query_id").agg(*[c.alias(n) for n, c in folds.items()])
    return _with_status(states, "running")


def closed_queries(events: DataFrame, timeout: str = TIMEOUT, late: str = LATE) -> DataFrame:
    """Each query once it is over, its state forgotten then (append mode).

    A query is over when nothing arrived for the timeout; without a terminal event
    it counts as ``abandoned``.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    sessions = timed.groupBy("query_id", F.session_window("ts", timeout).alias("w")).agg(*_state_parts())
    return _with_status(sessions, "abandoned").withColumn("closed_at", F.col("w.end")).drop("w")


def first_terminal_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """Terminal events without repeats of the same kind for one query."""
    terminal = events.where(F.col("event_type").isin(COMPLETE, ERROR))
    return terminal.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id", "event_type"])


def windowed_parts(events: DataFrame, window: str = "1 hour", late: str = LATE) -> DataFrame:
    """Parts of the fleet metrics per time window and tool; :func:`windowed_metrics` folds what is kept of them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    parts = timed.groupBy(F.window("ts", window).alias("w"), metric_key()).agg(*metric_parts())
    return parts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *parts.columns[1:])


def windowed_metrics(parts: DataFrame) -> DataFrame:
    """Fleet metrics per time window."""
    return fold_metrics(parts, "window_start", "window_end")
