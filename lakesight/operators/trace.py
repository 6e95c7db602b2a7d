"""Agent traces: primary results, outcomes, fleet metrics and load tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions import questions as Q
from lakesight.functions.formats import mean
from lakesight.operators.ordered import carry_last

# Names of events and tools in a trace.
TOOL_CALL = "tool_call_complete"
COMPLETE = "complete"
ERROR = "error"
SYNTHESIS = "pseudo_tool#llm_synthesize_answer"
SQL_TOOL, SEARCH_TOOL, GENERATE_TOOL = "execute_sql", "semantic_search", "generate_sql"
TOOLS = [GENERATE_TOOL, SQL_TOOL, SEARCH_TOOL]
RETRIEVAL = [SQL_TOOL, SEARCH_TOOL]
TOKEN_KINDS = ["input_tokens", "output_tokens", "total_tokens"]
MAX_ITERATIONS = 5
LOAD_BATCH = 64

# Openings of a placeholder given instead of a statement.
SQL_PLACEHOLDERS = ["(the sql", "the sql query", "[the sql"]


def tool_results(trace: DataFrame) -> DataFrame:
    """Completed tool calls, the final synthesis step left out."""
    return trace.where((F.col("event_type") == TOOL_CALL) & (F.col("tool") != SYNTHESIS))


def summaries(trace: DataFrame) -> DataFrame:
    """Every tool result with its one-line summary."""
    retrieval = F.col("tool").isin(RETRIEVAL)
    text = Q.result_summary(
        F.col("success"), F.col("error"), F.col("row_count"), retrieval, F.col("sql").isNotNull()
    )
    return tool_results(trace).withColumn("summary", text)


def _last(value: str, when: Column) -> Column:
    """The value on the last row (by ``seq``) that meets the condition."""
    return F.max_by(F.when(when, F.col(value)), F.when(when, F.col("seq")))


def _selection(trace: DataFrame) -> dict[str, Column]:
    succeeded = (F.col("event_type") == TOOL_CALL) & F.coalesce("success", F.lit(False))
    with_rows = succeeded & (F.coalesce("row_count", F.lit(0)) > 0)
    on = lambda tool, base: base & (F.col("tool") == tool)
    return {
        "sql_rows": _last("row_count", on(SQL_TOOL, with_rows)),
        "sql_seq": F.max(F.when(on(SQL_TOOL, with_rows), F.col("seq"))),
        "semantic_rows": _last("row_count", on(SEARCH_TOOL, with_rows)),
        "semantic_seq": F.max(F.when(on(SEARCH_TOOL, with_rows), F.col("seq"))),
        "generate_summary": _last("summary", on(GENERATE_TOOL, succeeded)),
        "semantic_summary": _last("summary", on(SEARCH_TOOL, succeeded)),
    }


def _result_type() -> Column:
    return F.when(F.col("sql_seq").isNotNull(), "sql").when(F.col("semantic_seq").isNotNull(), "semantic")


def primary_results(trace: DataFrame) -> DataFrame:
    """Per query: the last SQL result with rows, else the last search result with rows.

    The context names the other useful calls: the generated SQL when no SQL result
    is used, the search when one is. Everything is a mergeable aggregate, so a query
    with very many calls is reduced where its rows are read.
    """
    rows = summaries(trace)
    picked = rows.groupBy("query_id").agg(*[c.alias(n) for n, c in _selection(rows).items()])
    kind = _result_type()
    entry = lambda tool, summary: F.struct(F.lit(tool).alias("tool"), F.col(summary).alias("summary"))
    context = F.array_compact(
        F.array(
            F.when(F.col("generate_summary").isNotNull() & F.col("sql_seq").isNull(),
                   entry(GENERATE_TOOL, "generate_summary")),
            F.when(F.col("semantic_summary").isNotNull() & (kind == "sql"), entry(SEARCH_TOOL, "semantic_summary")),
        )
    )
    return picked.select(
        "query_id",
        kind.alias("primary_result_type"),
        F.coalesce("sql_seq", "semantic_seq").alias("primary_seq"),
        F.coalesce("sql_rows", "semantic_rows", F.lit(0)).cast("long").alias("primary_result_row_count"),
        context.alias("context_results"),
    )


def last_result_with_rows(trace: DataFrame, tool: str) -> DataFrame:
    """Per query: the last successful call of one tool that returned rows."""
    hit = (F.col("tool") == tool) & F.coalesce("success", F.lit(False)) & (F.coalesce("row_count", F.lit(0)) > 0)
    return (
        tool_results(trace)
        .where(hit)
        .groupBy("query_id")
        .agg(F.max("seq").alias("seq"), F.max_by("row_count", "seq").alias("row_count"))
    )


def outcomes(trace: DataFrame) -> DataFrame:
    """One row per query: whether data was found, which result is used, and the answer given."""
    rows = trace.withColumn(
        "summary",
        Q.result_summary(
            F.col("success"), F.col("error"), F.col("row_count"), F.col("tool").isin(RETRIEVAL),
            F.col("sql").isNotNull(),
        ),
    )
    called = (F.col("event_type") == TOOL_CALL) & (F.col("tool") != SYNTHESIS)
    retrieval = called & F.col("tool").isin(RETRIEVAL)
    picked = _selection(rows)
    folded = rows.groupBy("query_id").agg(
        *[picked[n].alias(n) for n in ("sql_rows", "sql_seq", "semantic_rows", "semantic_seq")],
        F.count_if(called).alias("n_calls"),
        F.count_if(retrieval).alias("n_retrievals"),
        F.count_if(retrieval & F.coalesce("success", F.lit(False))).alias("n_retrieved"),
        F.max("iteration").alias("iterations"),
        _last("answer", F.col("event_type") == COMPLETE).alias("answer"),
    )
    has_data = F.col("sql_seq").isNotNull() | F.col("semantic_seq").isNotNull()
    # No call at all counts as "all fine"; calls without a retrieval do not.
    tools_ok = F.when(F.col("n_calls") == 0, True).otherwise(
        (F.col("n_retrievals") > 0) & (F.col("n_retrieved") == F.col("n_retrievals"))
    )
    hit_limit = F.coalesce(F.col("iterations") >= MAX_ITERATIONS, F.lit(False))
    return folded.select(
        "query_id",
        has_data.alias("data_available"),
        _result_type().alias("primary_result_type"),
        F.coalesce("sql_rows", "semantic_rows", F.lit(0)).cast("long").alias("primary_result_row_count"),
        F.coalesce("iterations", F.lit(0)).alias("iterations"),
        "n_calls",
        Q.final_answer(F.col("answer"), has_data, tools_ok, hit_limit).alias("answer"),
    )


def needs_sql(sql: Column) -> Column:
    placeholder = F.lit(False)
    for opening in SQL_PLACEHOLDERS:
        placeholder = placeholder | F.lower(sql).startswith(opening)
    return F.coalesce(sql == "", F.lit(True)) | placeholder


def chain_generated_sql(trace: DataFrame) -> DataFrame:
    """Give each SQL call without a statement the most recent one generated before it in its query."""
    calls = tool_results(trace)
    generated = F.when(
        (F.col("tool") == GENERATE_TOOL) & F.coalesce("success", F.lit(False)) & F.col("sql").isNotNull(),
        F.col("sql"),
    )
    carried = carry_last(calls.withColumn("_generated", generated), "_generated", "previous_sql", ["query_id"])
    run = carried.where(F.col("tool") == SQL_TOOL)
    lacking = needs_sql(F.col("sql"))
    return run.withColumns(
        {
            "sql_to_run": F.when(lacking, F.coalesce("previous_sql", "sql")).otherwise(F.col("sql")),
            "chained": lacking & F.col("previous_sql").isNotNull(),
        }
    ).drop("_generated", "previous_sql")


# ---- metrics ----------------------------------------------------------------------------------

def _exact(c: str) -> Column:
    """Milliseconds as a decimal, so that the sum does not depend on row order."""
    return F.col(c).cast("decimal(18,6)")


def _tool_call() -> Column:
    return (F.col("event_type") == TOOL_CALL) & (F.col("tool") != SYNTHESIS)


def metric_key() -> Column:
    """The tool of a completed call, NULL for all other events."""
    return F.when(_tool_call(), F.col("tool")).alias("tool")


def metric_parts() -> list[Column]:
    """Mergeable parts of the fleet metrics, to be grouped by :func:`metric_key` among others.

    Query records are the terminal events; tool records the completed calls.
    """
    query = F.col("event_type").isin(COMPLETE, ERROR)
    called = F.coalesce(_tool_call(), F.lit(False))
    recorded = query | called
    parts = [
        F.count_if(query).alias("queries"),
        F.count_if(F.col("event_type") == COMPLETE).alias("won"),
        F.count_if(F.col("event_type") == ERROR).alias("lost"),
        F.sum(F.when(query, _exact("execution_time_ms"))).alias("latency"),
        F.count(F.when(query, F.col("execution_time_ms"))).alias("latency_n"),
        F.sum(F.when(query, F.col("iteration"))).alias("iterations"),
        F.count(F.when(query, F.col("iteration"))).alias("iterations_n"),
        F.count_if(recorded & (F.col("total_tokens") > 0)).alias("with_tokens"),
        F.count_if(called).alias("calls"),
        F.count_if(called & ~F.coalesce("success", F.lit(False))).alias("failed"),
    ]
    for kind in TOKEN_KINDS:
        positive = F.when(recorded & (F.col(kind) > 0), F.col(kind))
        parts += [F.sum(positive).alias(kind), F.count(positive).alias(f"{kind}_n")]
    return parts


def fold_metrics(parts: DataFrame, *keys: str) -> DataFrame:
    """Fleet metrics out of parts per key and tool.

    The per-tool maps have an entry for every tool that occurs, so they grow with the
    number of tools and not with the events.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    average = lambda c: F.coalesce(mean(F.sum(c), F.sum(f"{c}_n")), F.lit(0.0))
    per_tool = lambda c, name: F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("tool").isNotNull() & (F.col(c) > 0), F.struct(name.alias("key"), F.col(c).alias("value"))))))
    columns = {
        "total_queries": total("queries"),
        "success_count": total("won"),
        "failure_count": total("lost"),
        "success_rate": F.coalesce(
            F.try_divide(F.sum("won").cast("double"), F.sum("queries").cast("double")) * 100, F.lit(0.0)),
        "avg_latency_ms": average("latency"),
        "avg_iterations": average("iterations"),
    }
    for kind in TOKEN_KINDS:
        columns[kind if kind == "total_tokens" else f"total_{kind}"] = total(kind)
        columns[f"avg_{kind}"] = average(kind)
    columns["token_calls"] = total("with_tokens")
    columns["tool_calls"] = per_tool("calls", F.col("tool"))
    columns["errors"] = F.map_concat(
        F.map_filter(F.create_map(F.lit(ERROR), total("lost")), lambda _, v: v > 0),
        per_tool("failed", F.concat(F.lit("tool_"), "tool")),
    )
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def agent_metrics(trace: DataFrame, *keys: Column) -> DataFrame:
    """Fleet metrics in one row, or one row per key."""
    parts = trace.groupBy(*keys, metric_key()).agg(*metric_parts())
    return fold_metrics(parts, *[c for c in parts.columns[: len(keys)]])


def tool_counts(trace: DataFrame) -> DataFrame:
    """Calls and failures of every tool that occurs."""
    return (
        tool_results(trace)
        .groupBy("tool")
        .agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("success", F.lit(False))).alias("errors"))
    )


# ---- load statuses ----------------------------------------------------------------------------

def top_errors(statuses: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent error keys."""
    return (
        statuses.where(~F.col("ok"))
        .groupBy(Q.error_key(F.col("error")).alias("error_key"))
        .agg(F.count("*").alias("occurrences"))
        .orderBy(F.col("occurrences").desc(), F.col("error_key").asc_nulls_last())
        .limit(n)
    )


def load_tally(statuses: DataFrame, size: int = LOAD_BATCH) -> DataFrame:
    """Successes and errors per batch of the load, and over all (NULL batch)."""
    batch = F.floor(F.col("seq") / size).cast("long")
    return (
        statuses.select(batch.alias("batch"), "ok")
        .rollup("batch")
        .agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    )


# ---- conversations -----------------------------------------------------------------------------

def last_messages(messages: DataFrame) -> DataFrame:
    """Per conversation: the last user and assistant texts."""
    said = lambda role: F.max_by(
        F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))
    )
    return messages.groupBy("conv_id").agg(said("user").alias("last_user"), said("assistant").alias("last_assistant"))


def answers_to_add(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (``conv_id``, ``question``, ``answer``) not yet shown: the question is the
    last user message, and the answer is not the last assistant message."""
    known = answers.where(
        (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != "")
    ).join(last_messages(messages), "conv_id")
    return known.where(
        (F.col("last_user") == F.col("question")) & ~F.col("last_assistant").eqNullSafe(F.col("answer"))
    ).select("conv_id", "question", "answer")
