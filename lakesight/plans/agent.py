"""Registered queries: agent traces, event texts, logs and load statuses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions import cleaning, loglines, places, questions as Q, text as X
from lakesight.operators import events as E, logs as L, ordered, trace as T
from lakesight.plans import derive as D
from lakesight.plans.registry import Registry
from lakesight.sources import tables as S

agent = Registry()

SUMMARY_SQL = """CASE WHEN NOT success THEN 'Error: ' || coalesce(error, 'Unknown error')
  WHEN tool IN ('execute_sql', 'semantic_search') THEN 'Retrieved ' || coalesce(row_count, 0) || ' rows'
  WHEN sql IS NOT NULL THEN 'Generated SQL query' ELSE 'Completed successfully' END"""

PICK = f"""
WITH t AS ({D.TRACE_SQL}), c AS (SELECT *, {SUMMARY_SQL} AS summary FROM t WHERE event_type = 'tool_call_complete'),
p AS (SELECT query_id,
  max(seq) FILTER (WHERE tool = 'execute_sql' AND success AND row_count > 0) AS sql_seq,
  arg_max(row_count, seq) FILTER (WHERE tool = 'execute_sql' AND success AND row_count > 0) AS sql_rows,
  max(seq) FILTER (WHERE tool = 'semantic_search' AND success AND row_count > 0) AS sem_seq,
  arg_max(row_count, seq) FILTER (WHERE tool = 'semantic_search' AND success AND row_count > 0) AS sem_rows,
  arg_max(summary, seq) FILTER (WHERE tool = 'generate_sql' AND success) AS gen_summary,
  arg_max(summary, seq) FILTER (WHERE tool = 'semantic_search' AND success) AS sem_summary,
  count(*) FILTER (WHERE tool IN ('execute_sql', 'semantic_search')) AS n_ret,
  count(*) FILTER (WHERE tool IN ('execute_sql', 'semantic_search') AND success) AS n_ok, count(*) AS n_calls
  FROM c GROUP BY query_id)
"""


@agent.register(f"""{PICK}
SELECT query_id, CASE WHEN sql_seq IS NOT NULL THEN 'sql' WHEN sem_seq IS NOT NULL THEN 'semantic' END AS primary_result_type,
  coalesce(sql_seq, sem_seq) AS primary_seq, coalesce(sql_rows, sem_rows, 0) AS primary_result_row_count,
  CASE WHEN sql_seq IS NULL AND gen_summary IS NOT NULL THEN 'generate_sql=' || gen_summary
       WHEN sql_seq IS NOT NULL AND sem_summary IS NOT NULL THEN 'semantic_search=' || sem_summary ELSE '' END AS context
FROM p""")
def primary_results(spark: SparkSession, folder: str) -> DataFrame:
    """The result each query's answer rests on, and the calls that give context."""
    rows = T.primary_results(D.trace(spark, folder))
    context = F.transform("context_results", lambda c: F.concat(c["tool"], F.lit("="), c["summary"]))
    return rows.withColumn("context", F.array_join(context, "; ")).drop("context_results")


@agent.register(f"""WITH t AS ({D.TRACE_SQL})
SELECT query_id, max(seq) AS seq, arg_max(row_count, seq) AS row_count FROM t
WHERE event_type = 'tool_call_complete' AND tool = 'semantic_search' AND success AND row_count > 0 GROUP BY query_id""")
def last_search_with_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The last search of each query that found something."""
    return T.last_result_with_rows(D.trace(spark, folder), T.SEARCH_TOOL)


@agent.register(f"""{PICK},
a AS (SELECT query_id, max(iteration) AS iterations,
        arg_max(answer, seq) FILTER (WHERE event_type = 'complete') AS answer FROM t GROUP BY query_id)
SELECT a.query_id, coalesce(sql_seq, sem_seq) IS NOT NULL AS data_available,
  CASE WHEN sql_seq IS NOT NULL THEN 'sql' WHEN sem_seq IS NOT NULL THEN 'semantic' END AS primary_result_type,
  coalesce(sql_rows, sem_rows, 0) AS primary_result_row_count, iterations, coalesce(n_calls, 0) AS n_calls,
  CASE WHEN coalesce(sql_seq, sem_seq) IS NOT NULL THEN answer
       WHEN coalesce(n_calls, 0) = 0 OR (n_ret > 0 AND n_ok = n_ret) THEN '{Q.ANSWER_NO_DATA}'
       WHEN iterations >= 5 THEN '{Q.ANSWER_LIMIT}' ELSE '{Q.ANSWER_FAILED}' END AS answer
FROM a LEFT JOIN p USING (query_id)""")
def query_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome and final answer of every query."""
    return T.outcomes(D.trace(spark, folder))


@agent.register(f"""WITH t AS (SELECT * FROM ({D.TRACE_SQL}) WHERE event_type = 'tool_call_complete'),
c AS (SELECT *, last_value(CASE WHEN tool = 'generate_sql' AND success THEN sql END IGNORE NULLS) OVER (
        PARTITION BY query_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
x AS (SELECT *, (sql IS NULL OR sql = '' OR lower(sql) LIKE '(the sql%') AS lacking FROM c WHERE tool = 'execute_sql')
SELECT query_id, seq, CASE WHEN lacking THEN coalesce(prev, sql) ELSE sql END AS sql_to_run,
       lacking AND prev IS NOT NULL AS chained FROM x""")
def chained_sql(spark: SparkSession, folder: str) -> DataFrame:
    """SQL calls without a statement take the one generated before them."""
    return T.chain_generated_sql(D.trace(spark, folder)).select("query_id", "seq", "sql_to_run", "chained")


@agent.register(f"""WITH t AS ({D.TRACE_SQL}) SELECT seq, {SUMMARY_SQL} AS summary FROM t
WHERE event_type = 'tool_call_complete'""")
def tool_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """One-line summary of every tool result."""
    return T.summaries(D.trace(spark, folder)).select("seq", "summary")


TOKENS_SQL = ", ".join(
    f"coalesce(CAST(sum({c}) FILTER (WHERE {c} > 0) AS BIGINT), 0) AS {c if c == 'total_tokens' else 'total_' + c}, "
    f"coalesce(CAST(sum({c}) FILTER (WHERE {c} > 0) AS DOUBLE) / CAST(count(*) FILTER (WHERE {c} > 0) AS DOUBLE), 0.0) AS avg_{c}"
    for c in ("input_tokens", "output_tokens", "total_tokens")
)
METRICS_SQL = f"""
  count(*) FILTER (WHERE q) AS total_queries, count(*) FILTER (WHERE event_type = 'complete') AS success_count,
  count(*) FILTER (WHERE event_type = 'error') AS failure_count,
  coalesce(CAST(count(*) FILTER (WHERE event_type = 'complete') AS DOUBLE)
           / nullif(CAST(count(*) FILTER (WHERE q) AS DOUBLE), 0) * 100, 0.0) AS success_rate,
  coalesce(CAST(sum(CAST(execution_time_ms AS DECIMAL(18,6))) FILTER (WHERE q) AS DOUBLE)
           / nullif(CAST(count(*) FILTER (WHERE q) AS DOUBLE), 0), 0.0) AS avg_latency_ms,
  coalesce(CAST(sum(iteration) FILTER (WHERE q) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE q) AS DOUBLE), 0), 0.0)
    AS avg_iterations,
  {TOKENS_SQL}, count(*) FILTER (WHERE total_tokens > 0) AS token_calls,
  count(*) FILTER (WHERE c AND tool = 'generate_sql') AS generate_sql_calls,
  count(*) FILTER (WHERE c AND tool = 'execute_sql') AS execute_sql_calls,
  count(*) FILTER (WHERE c AND tool = 'semantic_search') AS semantic_search_calls,
  count(*) FILTER (WHERE c AND tool = 'execute_sql' AND NOT success) AS execute_sql_errors,
  count(*) FILTER (WHERE c AND tool = 'semantic_search' AND NOT success) AS semantic_search_errors,
  count(*) FILTER (WHERE event_type = 'error') AS query_errors
"""
FLAGGED = f"""SELECT *, event_type IN ('complete', 'error') AS q, event_type = 'tool_call_complete' AS c FROM ({D.TRACE_SQL})"""


def flat_metrics(metrics: DataFrame) -> DataFrame:
    count = lambda m, key: F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0))
    return metrics.withColumns(
        {
            **{f"{t}_calls": count(F.col("tool_calls"), t) for t in T.TOOLS},
            **{f"{t}_errors": count(F.col("errors"), f"tool_{t}") for t in T.RETRIEVAL},
            "query_errors": count(F.col("errors"), "error"),
        }
    ).drop("tool_calls", "errors")


@agent.register(f"SELECT {METRICS_SQL} FROM ({FLAGGED})")
def agent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Fleet metrics over all queries and tool calls."""
    return flat_metrics(T.agent_metrics(D.trace(spark, folder)))


@agent.register(f"""SELECT CAST(ts AS DATE) AS day, {METRICS_SQL} FROM ({FLAGGED}) GROUP BY 1""")
def daily_agent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Fleet metrics per day."""
    return flat_metrics(T.agent_metrics(D.trace(spark, folder), F.col("ts").cast("date").alias("day")))


@agent.register(f"""WITH t AS ({D.TRACE_SQL})
SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS errors FROM t
WHERE event_type = 'tool_call_complete' GROUP BY tool""")
def tool_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and failures per tool."""
    return T.tool_counts(D.trace(spark, folder))


# ---- load statuses ------------------------------------------------------------------------------

STATUS_SQL = D.shaped_sql("events", D.STATUSES)


@agent.register(f"""WITH s AS ({STATUS_SQL}), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS island FROM s)
SELECT seq, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY island ORDER BY seq)::BIGINT AS streak FROM g""")
def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Failures in a row at every step of the load."""
    statuses = D.shaped(spark, folder, "events", D.STATUSES)
    return ordered.failure_streaks(statuses.select("seq", "ok"))


@agent.register(f"""WITH s AS ({STATUS_SQL}), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS island FROM s),
r AS (SELECT seq, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY island ORDER BY seq) AS streak FROM g)
SELECT min(seq) AS abort_seq FROM r WHERE streak >= 10""")
def load_abort_point(spark: SparkSession, folder: str) -> DataFrame:
    """Where ten failures in a row stop the load."""
    statuses = D.shaped(spark, folder, "events", D.STATUSES)
    return ordered.abort_point(ordered.failure_streaks(statuses.select("seq", "ok")))


@agent.register(f"""SELECT CASE WHEN contains(error, ':') THEN split_part(error, ':', 1) ELSE left(error, 100) END AS error_key,
count(*) AS occurrences FROM ({STATUS_SQL}) WHERE NOT ok GROUP BY 1 ORDER BY occurrences DESC, error_key LIMIT 3""")
def top_load_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent error kinds of the load."""
    return T.top_errors(D.shaped(spark, folder, "events", D.STATUSES))


@agent.register(f"""SELECT seq // 64 AS batch, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed
FROM ({STATUS_SQL}) GROUP BY ROLLUP (1)""")
def load_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Successes and errors per batch of 64 and in all."""
    return T.load_tally(D.shaped(spark, folder, "events", D.STATUSES))


# ---- event texts, logs, durations -------------------------------------------------------------------

DUCK_BLOCKS = f"""
WITH b AS (SELECT event_id, unnest(string_split(body, chr(10) || chr(10))) AS block,
             generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM ({D.shaped_sql('events', D.BODIES)})),
l AS (SELECT event_id, i, list_transform(list_filter(string_split(block, chr(10)), lambda x: starts_with(x, 'event:')),
               lambda x: trim(substr(x, 7)))[-1] AS ev,
             list_filter(list_transform(list_filter(string_split(block, chr(10)), lambda x: starts_with(x, 'data:')),
               lambda x: trim(substr(x, 6))), lambda x: json_valid(x))[-1] AS js FROM b)
"""


@agent.register(f"""{DUCK_BLOCKS}
SELECT event_id, arg_max(json_extract_string(js, '$.answer'), i) FILTER (WHERE ev = 'complete' AND json_exists(js, '$.answer')) AS answer,
  arg_max(json_extract_string(js, '$.message'), i) FILTER (WHERE ev = 'error' AND json_exists(js, '$.message')) AS error_message
FROM l GROUP BY event_id""")
def event_text_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Final answer and last error of every event text."""
    return E.parse_bodies(D.shaped(spark, folder, "events", D.BODIES)).drop("body")


LINES_SQL = D.shaped_sql("events", D.LINES)
STAMP = r"regexp_extract(line, '\[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)[^\]]*\]', 1)"


@agent.register(f"""SELECT line_no, CAST(left({STAMP}, 26) AS TIMESTAMP) AS ts,
CAST(regexp_extract(line, 'LOADED_COUNT=(\\d+)', 1) AS BIGINT) AS announced FROM ({LINES_SQL}) WHERE {STAMP} <> ''""")
def log_times(spark: SparkSession, folder: str) -> DataFrame:
    """Time and announced count of every stamped log line."""
    lines = L.with_time(L.stamped(D.shaped(spark, folder, "events", D.LINES)))
    return lines.select("line_no", "ts", loglines.announced_count(F.col("line"), "LOADED").alias("announced"))


MARK = datetime(2024, 1, 15, 12, 0, 0)


@agent.register(f"""SELECT line_no, CAST(left({STAMP}, 26) AS TIMESTAMP) AS ts FROM ({LINES_SQL})
WHERE {STAMP} <> '' AND CAST(left({STAMP}, 26) AS TIMESTAMP) > TIMESTAMP '2024-01-15 12:00:00'""")
def new_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines later than the mark."""
    return L.new_lines(D.shaped(spark, folder, "events", D.LINES), MARK).select("line_no", "ts")


@agent.register(f"SELECT max(CAST(nullif(left({STAMP}, 26), '') AS TIMESTAMP)) AS mark FROM ({LINES_SQL})")
def log_mark(spark: SparkSession, folder: str) -> DataFrame:
    """The mark once these lines were read."""
    return L.next_mark(D.shaped(spark, folder, "events", D.LINES), MARK)


@agent.register(f"""WITH p AS ({D.shaped_sql('events', D.PHASES)})
SELECT scope, component, identifier, duration_sec, false AS is_total FROM p
UNION ALL SELECT 'Total', '', '', CAST(sum(CAST(duration_sec AS DECIMAL(18,6))) AS DOUBLE), true FROM p HAVING count(*) > 0""")
def duration_table(spark: SparkSession, folder: str) -> DataFrame:
    """Run durations with a grand total."""
    return L.duration_table(D.shaped(spark, folder, "events", D.PHASES))


@agent.register(f"""SELECT page_id, CASE WHEN contains(path, 'nonkube') AND NOT contains(path, 'shared') THEN 'nonkube'
WHEN contains(path, 'kube') AND NOT contains(path, 'nonkube') THEN 'kube'
WHEN contains(path, 'shared') AND contains(path, 'nondurable') THEN 'shared-nondurable'
ELSE string_split(path, '/')[-1] END AS scope FROM ({D.shaped_sql('pages', D.PATHS)})""")
def stack_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Deployment scope of every path."""
    paths = D.shaped(spark, folder, "pages", D.PATHS)
    return paths.select("page_id", places.stack_scope(F.col("path")).alias("scope"))


# ---- questions, replies, answers ------------------------------------------------------------------------

@agent.register(f"""SELECT conv_id, turn, NOT regexp_matches(lower(question),
  'how many|count|total|sum|average|avg|min|max|top|bottom|trend') AS qualitative,
CASE WHEN regexp_matches(lower(question), 'how many|count|total|sum|average|avg|min|max|top|bottom|trend') THEN 'quantitative'
  WHEN regexp_matches(lower(question), 'why|complain|feedback|happy|satisfied|issue|problem|experience|sentiment') THEN 'qualitative'
  ELSE 'qualitative_default' END AS class,
CASE WHEN trim(question, E' \\t\\n\\r') = '' THEN 'query_text is too short' WHEN length(trim(question)) < 3 THEN 'x' END IS NULL AS searchable
FROM ({D.shaped_sql('conversations', D.QUESTIONS)})""")
def question_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Does a question ask for numbers or for opinions, and can it be searched for?"""
    rows = D.shaped(spark, folder, "conversations", D.QUESTIONS)
    return rows.select(
        "conv_id", "turn",
        Q.is_qualitative(F.col("question")).alias("qualitative"),
        Q.question_class(F.col("question")).alias("class"),
        Q.search_text_error(F.col("question")).isNull().alias("searchable"),
    )


@agent.register(f"""SELECT doc_id, CASE WHEN trim(question, E' \\t\\n\\r') = '' THEN 'Query cannot be empty'
WHEN length(question) > 1000 THEN 'Query too long (max 1000 characters)' END AS error,
regexp_matches(upper(question), ';|--|/\\*|\\*/|DROP|DELETE|UPDATE|INSERT') AS risky
FROM ({D.shaped_sql('documents', D.LONG_QUESTIONS)})""")
def question_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Blank and overlong questions are refused; risky tokens are reported."""
    rows = D.shaped(spark, folder, "documents", D.LONG_QUESTIONS)
    return rows.select(
        "doc_id", Q.question_error(F.col("question")).alias("error"), Q.question_is_risky(F.col("question")).alias("risky")
    )


@agent.register(f"""SELECT conv_id, turn, regexp_matches(answer, '\\d+\\.?\\d+') AS has_number,
regexp_matches(answer, '<generate_sql>|<execute_sql>|<semantic_search>') AS has_tag,
regexp_matches(lower(answer), 'based on query results|according to the data|the query results show|from the database|the data indicates|based on the information') AS claims_data
FROM ({D.shaped_sql('conversations', D.ANSWERS)})""")
def ungrounded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Signs of an answer that was made up."""
    rows, answer = D.shaped(spark, folder, "conversations", D.ANSWERS), F.col("answer")
    return rows.select(
        "conv_id", "turn",
        Q.answer_has_number(answer).alias("has_number"),
        Q.answer_has_tool_tag(answer).alias("has_tag"),
        Q.answer_claims_data(answer).alias("claims_data"),
    )


BARE = "trim(reply, E' \\t\\n\\r')"
for _fence in ("^```sql\\s*", "^```\\s*", "```\\s*$"):
    BARE = f"regexp_replace({BARE}, '(?m){_fence}', '', 'g')"


@agent.register(f"""SELECT conv_id, turn, trim(CASE WHEN regexp_matches(bare, '(?is)SELECT.*?;')
  THEN regexp_extract(bare, '(?is)(SELECT.*?;)', 1) ELSE bare END, E' \\t\\n\\r') AS statement
FROM (SELECT *, {BARE} AS bare FROM ({D.shaped_sql('conversations', D.REPLIES)}))""")
def extracted_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The statement inside a model reply."""
    rows = D.shaped(spark, folder, "conversations", D.REPLIES)
    return rows.select("conv_id", "turn", Q.extract_sql(F.col("reply")).alias("statement"))


@agent.register(f"""
WITH r AS ({D.shaped_sql('events', D.AGENT_REPLIES)}),
p AS (SELECT event_id, regexp_extract_all(reply, '(?i)TOOL:\\s*(\\w+)', 1) AS tools,
        regexp_extract_all(reply, '(?s)INPUT:\\s*(\\{{.*?\\}})', 1) AS inputs FROM r),
u AS (SELECT event_id, unnest(range(len(tools))) AS position, tools, inputs FROM p),
c AS (SELECT event_id, CAST(position AS INTEGER) AS position, lower(tools[position + 1]) AS tool, inputs[position + 1] AS raw FROM u),
f AS (SELECT *, coalesce(json_valid(raw), false) AS is_json,
  nullif(trim(regexp_extract(raw, '(?i)question["'']?\\s*:\\s*["'']?([^"'']+)', 1)), '') AS q0,
  nullif(trim(regexp_extract(raw, '(?i)query_text["'']?\\s*:\\s*["'']?([^"'']+)', 1)), '') AS t0,
  nullif(trim(regexp_extract(raw, '(?i)sql["'']?\\s*:\\s*["'']?([^"'']+)', 1)), '') AS s0,
  nullif(regexp_extract(raw, '(?i)limit["'']?\\s*:\\s*(\\d+)', 1), '') AS l0 FROM c)
SELECT event_id, position, tool, CASE WHEN is_json THEN json_extract_string(raw, '$.sql') ELSE s0 END AS sql,
  CASE WHEN NOT is_json THEN q0 END AS question, CASE WHEN NOT is_json THEN t0 END AS query_text,
  CASE WHEN NOT is_json THEN l0 END AS "limit" FROM f""")
def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool names and inputs found in agent replies."""
    rows = D.shaped(spark, folder, "events", D.AGENT_REPLIES)
    calls = rows.select("event_id", F.posexplode_outer(Q.tool_calls(F.col("reply"))).alias("position", "c"))
    calls = calls.where("position IS NOT NULL").select("event_id", "position", "c.tool", "c.input")
    field = lambda name: F.get_json_object("input", f"$.{name}").alias(name)
    return calls.select(
        "event_id", "position", "tool", field("sql"), field("question"), field("query_text"), field("limit")
    )


@agent.register(f"""WITH i AS (SELECT event_id, tool, {D.K} % 4 AS c, {D.K} AS k FROM ({D.shaped_sql('events', {**D.TOOL_INPUTS, 'props': 'props'})}))
SELECT event_id, tool, CASE c WHEN 0 THEN concat('q ', k) WHEN 3 THEN concat('asked ', event_id) END AS query_text,
  CASE c WHEN 1 THEN concat('SELECT ', k) END AS sql, CASE c WHEN 2 THEN concat('q ', k) END AS question,
  CASE c WHEN 0 THEN 'brand=B;store_name=a|b' WHEN 3 THEN 'brand=z;store_name=5' END AS filters FROM i""")
def tool_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs of tool calls under the names their tools read."""
    rows = D.shaped(spark, folder, "events", D.TOOL_INPUTS)
    asked = F.concat(F.lit("asked "), "event_id")
    read = rows.withColumn("i", Q.normalized_input(F.col("tool"), F.col("input"), asked, ["brand", "store_name"]))
    entries = F.transform(F.array_sort(F.map_entries("i.filters")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return read.select("event_id", "tool", "i.query_text", "i.sql", "i.question", F.array_join(entries, ";").alias("filters"))


@agent.register(f"""SELECT event_id, CASE
WHEN regexp_matches(lower(message), 'overloaded_error|rate_limit|throttl|api_error|internal server error') THEN false
WHEN contains(lower(message), 'not_found_error') OR (contains(lower(message), 'model:') AND contains(message, '404')) THEN true
WHEN contains(lower(message), 'invalid_api_key') OR (contains(lower(message), 'authentication') AND contains(lower(message), 'failed')) THEN true
WHEN contains(message, '''type'': ''error''') OR contains(replace(message, ' ', ''), '"type":"error"') THEN true ELSE false END AS fatal
FROM ({D.shaped_sql('events', D.ERRORS)})""")
def fatal_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Which error texts cannot be helped by another try."""
    rows = D.shaped(spark, folder, "events", D.ERRORS)
    return rows.select("event_id", Q.error_is_fatal(F.col("message")).alias("fatal"))


@agent.register("""SELECT event_id, CASE WHEN json_valid(v) THEN CAST(json(v) AS VARCHAR) ELSE v END AS value FROM (
SELECT event_id, CASE WHEN event_type = 'error' THEN 'plain ' || props ELSE props END AS v FROM events)""")
def json_or_text(spark: SparkSession, folder: str) -> DataFrame:
    """JSON columns parsed where they parse, kept as they are otherwise."""
    value = F.when(F.col("event_type") == "error", F.concat(F.lit("plain "), "props")).otherwise(F.col("props"))
    return S.table(spark, folder, "events").select("event_id", cleaning.json_or_text(value).alias("value"))


@agent.register("""SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short,
text AS whole FROM documents""")
def truncated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut to 80 characters; a limit of zero keeps them whole."""
    return S.table(spark, folder, "documents").select(
        "doc_id", X.truncate(F.col("text"), 80).alias("short"), X.truncate(F.col("text"), 0).alias("whole")
    )


# ---- conversations -----------------------------------------------------------------------------------------

@agent.register("""SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user,
arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id""")
def last_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last user and assistant texts of every conversation."""
    return T.last_messages(S.table(spark, folder, "conversations"))


@agent.register("""WITH m AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user,
  arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant,
  arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
SELECT conv_id, question, answer || '!' AS answer FROM m WHERE question <> '' AND answer || '!' <> ''
AND last_user = question AND (last_assistant IS DISTINCT FROM answer || '!')""")
def answers_to_add(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the last question of a conversation that are not shown yet."""
    messages = S.table(spark, folder, "conversations")
    first = lambda role: F.min_by(
        F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))
    )
    answers = messages.groupBy("conv_id").agg(
        first("user").alias("question"), F.concat(first("assistant"), F.lit("!")).alias("answer")
    )
    return T.answers_to_add(messages, answers)
