"""Guarded read-only SQL over registered views."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakesight.functions.text import strip

# Words a read-only statement must not contain, in the order they are reported.
REFUSED_WORDS = [
    "DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE", "INSERT", "UPDATE",
    "GRANT", "REVOKE", "EXEC", "EXECUTE",
]
# Refused in addition when guarding by whole words: Spark constructs that run outside code.
REFUSED_CALLS = ["TRANSFORM", "REFLECT", "JAVA_METHOD", "TRY_REFLECT"]
# Formats whose name before a path makes a relation of a file.
FILE_FORMATS = ["TEXT", "CSV", "JSON", "PARQUET", "ORC", "AVRO", "BINARYFILE", "DELTA"]
FILE_RELATION = rf"\b(FROM|JOIN|,)\s*({'|'.join(FILE_FORMATS)})\s*\."
# Plan nodes and expressions that run outside code.
REFUSED_CLASSES = ["CallMethodViaReflection", "TryReflect", "ScriptTransformation"]

ERROR_EMPTY = "SQL query is required"
ERROR_NOT_SELECT = "Only SELECT queries are allowed"
ERROR_FILE = "Reading files is not allowed"


def _word_error(word: str) -> str:
    return f"Dangerous SQL keyword '{word}' is not allowed"


def _call_error(word: str) -> str:
    return f"Function '{word}' is not allowed"


def guard_error(sql: Column, mode: str = "words") -> Column:
    """Why a statement is refused, NULL when it may run.

    ``substring`` looks for the words as substrings, so that a column named
    ``created_at`` is refused; ``words`` looks for whole words, and also refuses calls of
    outside code and files as relations, quoted or not. Texts can hide such calls;
    :func:`run_select` judges the plan as well.
    """
    upper = strip(F.upper(sql))
    rule = F.when(F.coalesce(sql == "", F.lit(True)), ERROR_EMPTY)
    for word in REFUSED_WORDS:
        hit = upper.contains(word) if mode == "substring" else upper.rlike(rf"\b{word}\b")
        rule = rule.when(hit, _word_error(word))
    rule = rule.when(~upper.startswith("SELECT"), ERROR_NOT_SELECT)
    if mode != "substring":
        bare = F.replace(upper, F.lit("`"), F.lit(""))
        for word in REFUSED_CALLS:
            rule = rule.when(bare.rlike(rf"\b{word}\b"), _call_error(word))
        rule = rule.when(bare.rlike(FILE_RELATION), ERROR_FILE)
    return rule


def check_statement(sql: str | None, mode: str = "words") -> str | None:
    """The same rules for one statement held by the caller."""
    if not sql:
        return ERROR_EMPTY
    upper = sql.upper().strip()
    for word in REFUSED_WORDS:
        if (word in upper) if mode == "substring" else re.search(rf"\b{word}\b", upper):
            return _word_error(word)
    if not upper.startswith("SELECT"):
        return ERROR_NOT_SELECT
    if mode != "substring":
        bare = upper.replace("`", "")
        for word in REFUSED_CALLS:
            if re.search(rf"\b{word}\b", bare):
                return _call_error(word)
        if re.search(FILE_RELATION, bare):
            return ERROR_FILE
    return None


def check_plan(rows: DataFrame) -> str | None:
    """Why an analysed statement is refused: it runs outside code or reads something that is no registered view."""
    plan = rows._jdf.queryExecution().analyzed()

    def walk(node, in_view: bool) -> str | None:
        name = node.nodeName()
        expressions = node.expressions()
        shown = [name, *[expressions.apply(i).toJSON() for i in range(expressions.size())]]
        for refused in REFUSED_CLASSES:
            if any(refused in text for text in shown):
                return f"{refused} is not allowed"
        in_view = in_view or name == "View"
        children, queries = node.children(), node.subqueries()
        if children.isEmpty() and not in_view and name not in ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef"):
            return f"{name} is no registered view"
        for below in (children, queries):
            for i in range(below.size()):
                refused = walk(below.apply(i), in_view)
                if refused:
                    return refused
        return None

    return walk(plan, False)


@dataclass
class Result:
    """Outcome of one statement; the rows stay distributed until asked for.

    An error that only shows when the rows are made turns the outcome into a failure.
    """

    success: bool
    sql: str | None
    rows: DataFrame | None = None
    columns: list[str] | None = None
    error: str | None = None

    def _run(self, action, none):
        if self.rows is None:
            return none
        try:
            return action(self.rows)
        except PySparkException as error:
            self.success, self.rows, self.error = False, None, f"Database error: {error}"
            return none

    def row_count(self) -> int:
        return self._run(lambda rows: rows.count(), 0)

    def payload(self, n: int = 10) -> list[str]:
        """The first rows as JSON texts."""
        return self._run(lambda rows: [r[0] for r in json_rows(rows.limit(n)).collect()], [])


FILES_SETTING = "spark.sql.runSQLOnFiles"


def run_select(spark: SparkSession, sql: str | None, mode: str = "words") -> Result:
    """Run a statement that passes the guard; errors are returned, not raised.

    Analysing a SELECT runs nothing; its plan is judged before anything does.
    """
    refused = check_statement(sql, mode)
    if refused:
        return Result(False, sql, error=refused)
    files = spark.conf.get(FILES_SETTING)
    spark.conf.set(FILES_SETTING, "false")
    try:
        rows = spark.sql(sql.strip())
        refused = check_plan(rows)
    except PySparkException as error:
        return Result(False, sql, error=f"Database error: {error}")
    finally:
        spark.conf.set(FILES_SETTING, files)
    if refused:
        return Result(False, sql, error=refused)
    return Result(True, sql, rows=rows, columns=rows.columns)


def _json_type(kind: T.DataType) -> T.DataType:
    """The type with decimals as doubles, at any depth."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_json_type(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_json_type(kind.keyType), _json_type(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _json_type(f.dataType), f.nullable) for f in kind.fields])
    return kind


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles; dates and times as ISO text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            fraction = F.date_format(c, "SSSSSS")
            c = F.concat(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""),
            )
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            c = c.cast(_json_type(field.dataType))
        columns.append(c.alias(field.name))
    return df.select(*columns)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object; NULL fields are kept."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def schema_listing(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table as text lines."""
    lines = [(i, f"- {f.name}: {f.dataType.simpleString()}") for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame([(0, f"Table: {table}"), *lines], "position int, line string")
