"""Rules over question text, model replies and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lakesight.functions.text import any_of, first_group, is_blank, strip

# Substrings that mark a question as asking for numbers.
QUANTITATIVE_WORDS = [
    "how many", "count", "total", "sum", "average", "avg", "min", "max",
    "top", "bottom", "trend",
]
# Substrings that mark a question as asking for opinions.
QUALITATIVE_WORDS = [
    "why", "complain", "complaints", "feedback", "happy", "unhappy",
    "satisfied", "dissatisfied", "issue", "problem", "experience", "sentiment",
]
# Tokens that are reported, never refused, in a question.
RISKY_TOKENS = [";", "--", "/*", "*/", "DROP", "DELETE", "UPDATE", "INSERT"]

MAX_QUESTION_LENGTH = 1000
MIN_SEARCH_LENGTH = 3

# Phrases in an answer that claim to rest on data.
DATA_PHRASES = [
    "based on query results", "according to the data", "the query results show",
    "from the database", "the data indicates", "based on the information",
]
# Tags of tools left in an answer.
TOOL_TAGS = ["<generate_sql>", "<execute_sql>", "<semantic_search>"]

# Answers given when a query found nothing.
ANSWER_NO_DATA = "No relevant data found for this query."
ANSWER_LIMIT = (
    "Search exceeded time and resource limit. Try again or contact your system admin to increase the limit."
)
ANSWER_FAILED = (
    "I cannot answer this question because I was unable to retrieve the required data from the database. "
    "All attempts to query the database failed. Please try rephrasing your question or check if the data is available."
)

# Error texts worth another try, and those that are not.
RETRIABLE_ERRORS = ["overloaded_error", "rate_limit", "throttl", "api_error", "internal server error"]


def is_qualitative(question: Column) -> Column:
    """Words match as substrings; numbers win over opinions, opinion is the default."""
    return ~F.lower(question).rlike(any_of(QUANTITATIVE_WORDS))


def question_class(question: Column) -> Column:
    lowered = F.lower(question)
    return (
        F.when(lowered.rlike(any_of(QUANTITATIVE_WORDS)), "quantitative")
        .when(lowered.rlike(any_of(QUALITATIVE_WORDS)), "qualitative")
        .otherwise("qualitative_default")
    )


def question_error(question: Column) -> Column:
    """Why a question is refused, or NULL when it is fine."""
    return F.when(is_blank(question), "Query cannot be empty").when(
        F.length(question) > MAX_QUESTION_LENGTH, "Query too long (max 1000 characters)"
    )


def question_is_risky(question: Column) -> Column:
    return F.upper(question).rlike(any_of(RISKY_TOKENS))


def search_text_error(text: Column) -> Column:
    return F.when(F.coalesce(text == "", F.lit(True)), "query_text is required").when(
        F.length(strip(text)) < MIN_SEARCH_LENGTH, "query_text must be at least 3 characters"
    )


def extract_sql(reply: Column) -> Column:
    """The first statement from SELECT to a semicolon, without code fences."""
    bare = strip(reply)
    for fence in (r"(?md)^```sql\s*", r"(?md)^```\s*", r"(?md)```\s*$"):
        bare = F.regexp_replace(bare, fence, "")
    statement = F.regexp_extract(bare, r"(?is)(SELECT.*?;)", 1)
    return strip(F.when(statement != "", statement).otherwise(bare))


def simple_input(text: Column) -> Column:
    """Named values picked out of text that is not JSON, as a struct."""
    def quoted(name: str) -> Column:
        return strip(first_group(text, rf"(?i){name}[\"']?\s*:\s*[\"']?([^\"']+)"))

    return F.struct(
        quoted("question").alias("question"),
        quoted("query_text").alias("query_text"),
        quoted("sql").alias("sql"),
        first_group(text, r"(?i)limit[\"']?\s*:\s*(\d+)").alias("limit"),
    )


def tool_calls(reply: Column) -> Column:
    """``TOOL:`` names paired by position with ``INPUT:`` objects.

    An input that is not JSON falls back to :func:`simple_input`; a missing one
    is an empty object.
    """
    tools = F.regexp_extract_all(reply, F.lit(r"(?i)TOOL:\s*(\w+)"), F.lit(1))
    inputs = F.regexp_extract_all(reply, F.lit(r"(?s)INPUT:\s*(\{.*?\})"), F.lit(1))

    def call(tool: Column, raw: Column) -> Column:
        parsed = F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(F.to_json(simple_input(raw)))
        return F.struct(
            F.lower(tool).alias("tool"), F.coalesce(F.when(raw.isNotNull(), parsed), F.lit("{}")).alias("input")
        )

    # Zipping pads the shorter list with NULL; inputs without a tool are left out.
    return F.filter(F.zip_with(tools, inputs, call), lambda c: c["tool"].isNotNull())


# For each tool, the field it reads and the names that callers use for it, in order.
INPUT_NAMES = {
    "semantic_search": ("query_text", ["query_text", "question", "query"]),
    "execute_sql": ("sql", ["sql", "sql_query", "query"]),
    "generate_sql": ("question", ["question", "query"]),
}


def normalized_input(tool: Column, given: Column, question: Column, filterable: Sequence[str]) -> Column:
    """A call's input as its tool reads it: ``struct<query_text, sql, question, filters>``.

    Fields under another of their names are moved; a search without a text searches for the
    question asked. Filterable columns named directly join the ``filters`` map, where a
    single value becomes a list; the map itself wins over them. Of other tools nothing is read.
    """
    fields = F.from_json(given, "map<string,string>")
    field = lambda name: F.try_element_at(fields, F.lit(name))
    taken = {}
    for name, (target, names) in INPUT_NAMES.items():
        value = F.coalesce(*[field(n) for n in names], *([question] if target == "query_text" else []))
        taken[target] = F.when(tool == name, value)
    named = F.coalesce(F.from_json(field("filters"), "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    direct = F.array_compact(F.array(*[
        F.when(field(c).isNotNull() & ~F.map_contains_key(named, c), F.struct(
            F.lit(c).alias("key"),
            F.coalesce(F.when(field(c).startswith("["), F.from_json(field(c), "array<string>")), F.array(field(c))).alias("value"),
        )) for c in filterable
    ]))
    filters = F.map_concat(named, F.map_from_entries(direct))
    return F.struct(
        *[taken[c].alias(c) for c in ("query_text", "sql", "question")],
        F.when((tool == "semantic_search") & (F.size(filters) > 0), filters).alias("filters"),
    )



def answer_has_number(answer: Column) -> Column:
    """Two digits at least: a lone digit does not count."""
    return answer.rlike(r"\d+\.?\d+")


def answer_has_tool_tag(answer: Column) -> Column:
    return answer.rlike("|".join(TOOL_TAGS))


def answer_claims_data(answer: Column) -> Column:
    return F.lower(answer).rlike(any_of(DATA_PHRASES))


def final_answer(answer: Column, has_data: Column, tools_ok: Column, hit_limit: Column) -> Column:
    """Keep a grounded answer; otherwise say why there is none."""
    return (
        F.when(has_data, answer)
        .when(tools_ok, ANSWER_NO_DATA)
        .when(hit_limit, ANSWER_LIMIT)
        .otherwise(ANSWER_FAILED)
    )


def error_is_fatal(message: Column) -> Column:
    """True when trying again cannot help; the first rule that applies decides."""
    low = F.lower(message)
    rule = (
        F.when(low.rlike(any_of(RETRIABLE_ERRORS)), False)
        .when(low.contains("not_found_error"), True)
        .when(low.contains("model:") & message.contains("404"), True)
        .when(low.contains("invalid_api_key"), True)
        .when(low.contains("authentication") & low.contains("failed"), True)
        .when(message.contains("'type': 'error'"), True)
        .when(F.replace(message, F.lit(" "), F.lit("")).contains('"type":"error"'), True)
        .otherwise(False)
    )
    return F.coalesce(rule, F.lit(False))


def result_summary(success: Column, error: Column, row_count: Column, has_rows: Column, has_sql: Column) -> Column:
    """One line about a tool result."""
    return (
        F.when(~F.coalesce(success, F.lit(False)),
               F.concat(F.lit("Error: "), F.coalesce(error, F.lit("Unknown error"))))
        .when(has_rows, F.concat(F.lit("Retrieved "), F.coalesce(row_count, F.lit(0)).cast("string"), F.lit(" rows")))
        .when(has_sql, "Generated SQL query")
        .otherwise("Completed successfully")
    )


def error_key(message: Column) -> Column:
    """The text before the first colon, or the first 100 characters."""
    return F.when(message.contains(":"), F.substring_index(message, ":", 1)).otherwise(F.substring(message, 1, 100))
