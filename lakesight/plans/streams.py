"""Registered queries: the streaming jobs, run over a table as it is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions.loglines import announced_count
from lakesight.plans import derive as D
from lakesight.plans.agent import FLAGGED, METRICS_SQL, STAMP, LINES_SQL, flat_metrics
from lakesight.plans.batch import RUN_AT
from lakesight.plans.registry import Registry
from lakesight.plans.retail import SUM_PRICE
from lakesight.session import scratch_folder
from lakesight.sources import tables as S
from lakesight.sources.store import TableStore
from lakesight.streaming import agent_events as A, keyed_state as K, log_tail as L, runs as R

streams = Registry()


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables as a file stream."""
    schema = S.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    columns = {**D.TRACE, "ts": "CAST(ts AS TIMESTAMP)"}
    rows = stream(spark, folder, "events").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return rows.withColumn("question", F.lit(None).cast("string"))


FOLD_SQL = """count(*) FILTER (WHERE event_type = 'tool_call_complete') AS calls,
  arg_max(iteration, seq) FILTER (WHERE event_type = 'complete')::BIGINT AS iterations,
  arg_max(execution_time_ms, seq) FILTER (WHERE event_type = 'complete') AS execution_time_ms,
  arg_max(answer, seq) FILTER (WHERE event_type = 'complete') AS answer,
  nullif(arg_max(coalesce(error, '-'), seq) FILTER (WHERE event_type = 'error'), '-') AS error, max(ts) AS last_ts,
  CASE WHEN count(*) FILTER (WHERE event_type = 'complete') > 0 THEN 'complete'
       WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'error' ELSE '{unfinished}' END AS status"""
STATE_COLUMNS = ["query_id", "calls", "iterations", "execution_time_ms", "answer", "error", "status"]


@streams.register(f"SELECT query_id, {FOLD_SQL.format(unfinished='running')} FROM ({D.TRACE_SQL}) GROUP BY query_id")
def stream_query_states(spark: SparkSession, folder: str) -> DataFrame:
    """Execution state of every query, folded from the event stream."""
    path = scratch_folder(spark, "states")
    parts = R.run_updated(
        A.state_parts(trace_stream(spark, folder)), f"{path}/out", f"{path}/checkpoint", ["query_id", "window_start"]
    )
    return A.query_states(parts).select(*STATE_COLUMNS, F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@streams.register(f"""
WITH t AS ({D.TRACE_SQL}),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY query_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM t),
s AS (SELECT *, sum(opens) OVER (PARTITION BY query_id ORDER BY ts) AS session FROM g),
f AS (SELECT query_id, session, {FOLD_SQL.format(unfinished='abandoned')} FROM s GROUP BY query_id, session)
SELECT {', '.join(STATE_COLUMNS)}, last_ts FROM f
WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_closed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that were silent for half an hour, with their final state."""
    path = scratch_folder(spark, "closed")
    closed = R.run_appended(A.closed_queries(trace_stream(spark, folder)), f"{path}/out", f"{path}/checkpoint")
    return closed.select(*STATE_COLUMNS, F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@streams.register(f"""SELECT DISTINCT query_id, event_type FROM ({D.TRACE_SQL}) WHERE event_type IN ('complete', 'error')""")
def stream_terminal_events(spark: SparkSession, folder: str) -> DataFrame:
    """Terminal events, repeats dropped as they arrive."""
    path = scratch_folder(spark, "terminal")
    events = A.first_terminal_events(trace_stream(spark, folder), "40 days").select("query_id", "event_type")
    return R.run_appended(events, f"{path}/out", f"{path}/checkpoint")


@streams.register(f"""
WITH t AS ({D.TRACE_SQL}),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY query_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM t),
s AS (SELECT *, sum(opens) OVER (PARTITION BY query_id ORDER BY ts) AS session FROM g)
SELECT query_id, event_type, min(ts) AS ts FROM s WHERE event_type IN ('complete', 'error') GROUP BY query_id, session, event_type""")
def stream_first_terminal_events(spark: SparkSession, folder: str) -> DataFrame:
    """The first terminal event of each kind of a query, anew after half an hour without a sign of it; state goes by timers."""
    path = scratch_folder(spark, "first-terminal")
    found = K.first_terminal_events(trace_stream(spark, folder), 30 * 60 * 1000)
    with K.state_store(spark):
        kept = R.run_appended(found, f"{path}/out", f"{path}/checkpoint")
    return kept.select("query_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@streams.register(f"SELECT date_trunc('hour', ts) AS hour, {METRICS_SQL} FROM ({FLAGGED}) GROUP BY 1")
def stream_agent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Fleet metrics per hour, updated while events arrive."""
    path = scratch_folder(spark, "metrics")
    parts = A.windowed_parts(trace_stream(spark, folder))
    rows = R.run_updated(parts, f"{path}/out", f"{path}/checkpoint", ["window_start", "tool"])
    return flat_metrics(A.windowed_metrics(rows)).withColumn("hour", F.col("window_start").cast("timestamp_ntz")).drop("window_start", "window_end")


@streams.register(f"""SELECT line, CAST(left({STAMP}, 26) AS TIMESTAMP) AS ts,
CAST(regexp_extract(line, 'LOADED_COUNT=(\\d+)', 1) AS BIGINT) AS announced FROM ({LINES_SQL}) WHERE {STAMP} <> ''""")
def stream_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Stamped log lines, each shown once."""
    path = scratch_folder(spark, "tail")
    lines = stream(spark, folder, "events").selectExpr(*[f"{e} AS {c}" for c, e in D.LINES.items()])
    twice = lines.unionByName(lines).select("line")
    shown = R.run_appended(L.tail(twice), f"{path}/out", f"{path}/checkpoint")
    return shown.select(
        "line", F.col("ts").cast("timestamp_ntz").alias("ts"), announced_count(F.col("line"), "LOADED").alias("announced")
    )


@streams.register(f"""
SELECT count(*) AS total_records, {SUM_PRICE} AS total_revenue FROM (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)""")
def stream_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arriving as a stream refresh the raw table and the snapshot."""
    path = scratch_folder(spark, "refresh")
    store = TableStore(spark, f"{path}/store")

    def prepare(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("brand"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").alias("sales_date"),
        )

    query = R.start_refresh(
        stream(spark, folder, "orders"), store, f"{path}/checkpoint", ["sales_date"], "kube",
        prepare=prepare, clock=lambda: RUN_AT,
    )
    query.awaitTermination()
    return store.read_appended("batch_analytics").select("total_records", "total_revenue")
