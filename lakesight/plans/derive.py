"""Input tables shaped from the driver's tables.

The shaping expressions are plain SQL that Spark and the oracle engine both read,
so that a query and its oracle start from the same rows and differ in the operator
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesight.session import materialize
from lakesight.sources.tables import table

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

# An agent trace out of the event stream: a query is one user's day.
TRACE = {
    "query_id": "concat(user_id, '-', CAST(CAST(ts AS DATE) AS STRING))",
    "seq": "event_id",
    "ts": "ts",
    "event_type": f"CASE WHEN event_type = 'purchase' THEN 'complete' "
                  f"WHEN event_type = 'error' AND {K} >= 80 THEN 'error' ELSE 'tool_call_complete' END",
    "iteration": f"CAST(1 + {K} % 5 AS INT)",
    "tool": f"CASE event_type WHEN 'click' THEN 'execute_sql' WHEN 'view' THEN 'semantic_search' "
            f"WHEN 'signup' THEN 'generate_sql' WHEN 'error' THEN "
            f"CASE WHEN {K} >= 80 THEN NULL WHEN {K} % 2 = 0 THEN 'execute_sql' ELSE 'semantic_search' END END",
    "success": "event_type <> 'error'",
    "row_count": f"CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN {K} < 50 THEN 0 ELSE {K} END END",
    "sql": f"CASE event_type WHEN 'signup' THEN concat('SELECT ', {K}) WHEN 'click' THEN "
           f"CASE {K} % 3 WHEN 0 THEN '(the SQL generated above)' WHEN 1 THEN NULL ELSE 'SELECT 1' END END",
    "error": f"CASE WHEN event_type = 'error' THEN CASE {K} % 4 WHEN 0 THEN concat('timeout: waited ', {K}) "
             f"WHEN 1 THEN 'connection lost' WHEN 2 THEN concat('row ', {K}, ' refused') ELSE NULL END END",
    "execution_time_ms": "value",
    "answer": f"CASE WHEN event_type = 'purchase' THEN concat('Total of ', {K}, ' sales') END",
    "input_tokens": f"CASE WHEN event_type = 'purchase' THEN {K} ELSE 0 END",
    "output_tokens": f"CASE WHEN event_type = 'purchase' THEN 2 * {K} ELSE 0 END",
    "total_tokens": f"CASE WHEN event_type = 'purchase' THEN 3 * {K} ELSE 0 END",
}

# Load statuses: long failure runs come from the hour of day.
STATUSES = {
    "seq": "event_id",
    "ok": f"NOT (event_type = 'error' OR {K} < 60)",
    "error": f"CASE WHEN event_type = 'error' THEN concat('schema: column ', {K}) ELSE concat('no connection ', event_type) END",
}

# Server-sent event texts, one per event.
BODIES = {
    "event_id": "event_id",
    "body": f"concat('event: question', chr(10), 'data: {{\"question\": \"q', {K}, '\"}}', chr(10), chr(10), "
            f"CASE event_type WHEN 'view' THEN concat('event: complete', chr(10), 'data: {{\"answer\": \"a', {K}, '\"}}', chr(10), chr(10)) "
            f"WHEN 'click' THEN concat('event: complete', chr(10), 'data: {{\"answer\": \"first\"}}', chr(10), chr(10), "
            f"'event:complete', chr(10), 'data:{{\"answer\": \"second ', {K}, '\"}}', chr(10), chr(10)) "
            f"WHEN 'purchase' THEN concat('event: complete', chr(10), 'data: {{\"iterations\": 2}}', chr(10), chr(10)) "
            f"WHEN 'signup' THEN concat('event: complete', chr(10), 'data: {{broken', chr(10), chr(10)) "
            f"ELSE concat('event: error', chr(10), 'data: {{\"message\": \"boom ', {K}, '\"}}', chr(10), chr(10)) END)",
}

# Container log lines; error events lack the timestamp.
LINES = {
    "line_no": "event_id",
    "line": "CASE WHEN event_type = 'error' THEN concat('plain ', event_id) "
            "ELSE concat('[', CAST(ts AS STRING), CASE WHEN event_type = 'view' THEN ' UTC' ELSE '' END, '] ', "
            f"event_type, ' LOADED_COUNT=', {K}) END",
}

PHASES = {
    "scope": "event_type",
    "component": "concat('step ', user_id)",
    "identifier": "CAST(event_id AS STRING)",
    "duration_sec": "value",
}

STATEMENTS = {
    "stmt_id": "event_id",
    "sql": f"CASE WHEN {K} % 11 = 0 THEN 'SELECT `reflect`(''java.util.UUID'', ''randomUUID'')' "
           f"WHEN {K} % 11 = 1 THEN 'SELECT reflect/**/(''java.lang.System'', ''exit'')' "
           f"WHEN {K} % 11 = 2 THEN 'SELECT * FROM text.`/etc/passwd`' ELSE CASE event_type WHEN 'view' THEN concat('  select count(*) from sales where k = ', {K}) "
           f"WHEN 'click' THEN 'SELECT created_at, updated FROM sales' "
           f"WHEN 'purchase' THEN 'WITH x AS (SELECT 1) SELECT * FROM x' "
           f"WHEN 'signup' THEN CASE {K} % 4 WHEN 0 THEN 'drop table sales' WHEN 1 THEN 'SELECT 1; delete from sales' "
           f"WHEN 2 THEN 'INSERT INTO sales VALUES (1)' ELSE 'EXECUTE plan' END "
           f"ELSE CASE WHEN {K} < 50 THEN '' ELSE 'SELECT reflect(''java.lang.System'', ''exit'')' END END END",
}

ERRORS = {
    "event_id": "event_id",
    "message": f"CASE {K} % 9 WHEN 0 THEN 'Overloaded_Error: wait' WHEN 1 THEN 'rate_limit hit, not_found_error' "
               f"WHEN 2 THEN 'not_found_error model: m' WHEN 3 THEN 'Model: m returned 404' WHEN 4 THEN 'invalid_api_key' "
               f"WHEN 5 THEN 'Authentication has failed' WHEN 6 THEN 'got {{\"type\" : \"error\"}}' "
               f"WHEN 7 THEN 'got {{''type'': ''error''}}' ELSE concat('status ', {K}) END",
}

# Questions: a keyword put before conversation texts, and documents of any length.
QUESTIONS = {
    "conv_id": "conv_id",
    "turn": "turn",
    "question": "CASE role WHEN 'user' THEN concat(CASE turn % 4 WHEN 0 THEN 'How many ' WHEN 1 THEN 'Why ' "
                "WHEN 2 THEN 'Discount ' ELSE '' END, text) WHEN 'system' THEN '  ' ELSE text END",
}
LONG_QUESTIONS = {
    "doc_id": "doc_id",
    "question": "CASE lang WHEN 'de' THEN concat(chr(10), ' ') WHEN 'es' THEN concat('drop; ', text) ELSE text END",
}
ANSWERS = {
    "conv_id": "conv_id",
    "turn": "turn",
    "answer": "CASE turn % 5 WHEN 0 THEN concat('Based on Query Results: ', text) WHEN 1 THEN concat('<execute_sql> ', text) "
              "WHEN 2 THEN concat('exactly 7 of ', role) WHEN 3 THEN 'worth 12.50 in all' ELSE text END",
}
REPLIES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "reply": "CASE turn % 3 WHEN 0 THEN concat('```sql', chr(10), 'Select ''', role, ''' as r', chr(10), 'from t;', chr(10), '```', chr(10), text) "
             "WHEN 1 THEN concat('  ', text, '  ') ELSE concat('```', chr(10), 'no statement for ', role, chr(10), '```') END",
}
AGENT_REPLIES = {
    "event_id": "event_id",
    "reply": f"concat('Plan.', chr(10), 'TOOL: Execute_SQL', chr(10), 'INPUT: ', CASE event_type "
             f"WHEN 'click' THEN concat('{{\"sql\": \"SELECT ', {K}, '\"}}') "
             f"WHEN 'view' THEN concat('{{question: why ', {K}, '}}') ELSE concat('{{''query_text'' : ''text ', {K}, ''', limit: ', {K}, '}}') END, "
             f"chr(10), 'tool: semantic_search', chr(10), CASE WHEN {K} < 50 THEN 'INPUT: {{}}' ELSE '' END)",
}

# Inputs of tool calls under the names that callers use.
TOOL_INPUTS = {
    "event_id": "event_id",
    "tool": f"CASE {K} % 4 WHEN 1 THEN 'execute_sql' WHEN 2 THEN 'generate_sql' ELSE 'semantic_search' END",
    "input": f"CASE {K} % 4 WHEN 0 THEN concat('{{\"question\": \"q ', {K}, '\", \"brand\": \"B\", \"store_name\": [\"a\", \"b\"], \"customer_feedback\": \"x\"}}') "
             f"WHEN 1 THEN concat('{{\"sql_query\": \"SELECT ', {K}, '\"}}') WHEN 2 THEN concat('{{\"query\": \"q ', {K}, '\"}}') "
             f"ELSE '{{\"brand\": 7, \"store_name\": 5, \"filters\": {{\"brand\": [\"z\"]}}}}' END",
}

PATHS = {
    "page_id": "page_id",
    "path": "CASE page_id % 5 WHEN 0 THEN concat('stacks/nonkube/', page_id) WHEN 1 THEN concat('stacks/kube/', page_id) "
            "WHEN 2 THEN 'stacks/shared_nondurable' WHEN 3 THEN concat('shared/nonkube/nondurable/', page_id) ELSE url END",
}

# A resource inventory out of the customer table.
NAMES = {
    0: "concat('acme-dev-frontend-', CASE WHEN c_nationkey % 2 = 0 THEN 'oac' ELSE 'kube-r1-oac' END)",
    1: "CASE c_nationkey % 5 WHEN 0 THEN concat('acme-dev-aws-load-balancer-controller-', c_custkey) "
       "WHEN 1 THEN concat('acme-dev-ecs-task-', c_custkey) WHEN 2 THEN concat('acme-dev-ebs-csi-', c_custkey) "
       "WHEN 3 THEN concat('acme-dev-extra-', c_custkey) ELSE concat('AWSServiceRole', c_custkey) END",
    2: "CASE c_nationkey % 4 WHEN 0 THEN concat('k8s-elb-lb', c_custkey // 10 % 40) WHEN 1 THEN concat('acme-alb-', c_custkey) "
       "WHEN 2 THEN concat('k8s-traffic-acmeeksdevr', c_nationkey % 3) ELSE concat('other-', c_custkey) END",
    3: "concat('lb', c_custkey // 10 % 20)",
    4: "CASE c_nationkey % 3 WHEN 0 THEN concat('k8s-acmekube-acmeapisv-', c_custkey) "
       "WHEN 1 THEN concat('k8s-ingressn-', c_custkey) ELSE concat('k8s-x-', c_custkey) END",
    5: "CASE c_nationkey % 4 WHEN 0 THEN concat('acme-delta-internal-dev-r', c_nationkey % 3) "
       "WHEN 1 THEN 'acme-tf-state-dev' WHEN 2 THEN concat('acme-dev-frontend-kube-r', c_nationkey % 3) "
       "ELSE concat('cdk-assets-', c_custkey) END",
    6: "CASE c_nationkey % 4 WHEN 0 THEN concat('/aws/eks/acme-eks-dev-r', c_nationkey % 3, '/cluster') "
       "WHEN 1 THEN '/acme/dev/app' WHEN 2 THEN concat('/acme/x/ecs-api/', c_custkey) ELSE concat('/aws/lambda/', c_custkey) END",
    7: "CASE WHEN c_nationkey % 2 = 0 THEN concat('acme/dev/key', c_custkey) ELSE concat('foreign/', c_custkey) END",
    8: "CASE WHEN c_nationkey % 2 = 0 THEN 'default' ELSE concat('acme-dev-vpc-', c_custkey) END",
    9: "CASE WHEN c_nationkey % 2 = 0 THEN concat('acme-api-img-dev-', c_custkey) ELSE concat('web-', c_custkey) END",
}
KINDS = ["cloudfront_oac", "iam_role", "security_group", "alb", "target_group", "s3", "log_group", "secret", "vpc", "ecr"]


def _case(key: str, values: dict[int, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def _div(expression: str, spark: bool) -> str:
    """Whole-number division is spelled differently in the two engines."""
    return expression.replace("//", "DIV") if spark else expression


def inventory_columns(spark: bool) -> dict[str, str]:
    kind = _case("c_custkey % 10", {i: f"'{k}'" for i, k in enumerate(KINDS)})
    name = _div(_case("c_custkey % 10", NAMES), spark)
    tags = "CASE WHEN c_acctbal > 0 THEN map({k}, {v}) ELSE map({k2}, {v2}) END"
    one = {
        "k": "['kubernetes.io/cluster/acme-dev-eks']", "v": "['owned']",
        "k2": "[concat('kubernetes.io/cluster/acme-eks-dev-r', c_nationkey % 3)]",
        "v2": "[CASE WHEN c_acctbal < -500 THEN 'shared' ELSE 'none' END]",
    }
    if spark:
        one = {k: v[1:-1] for k, v in one.items()}
    else:
        tags = tags.replace("map(", "MAP(")
    return {
        "seq": "c_custkey",
        "resource_type": kind,
        "name": name,
        "region": "CASE WHEN c_custkey % 10 IN (0, 1) THEN '' ELSE concat('r', c_nationkey % 3) END",
        "display": f"concat({kind}, ':', {name}, CASE WHEN c_custkey % 20 = 8 THEN ' (10.0.0.0/16) [x]' ELSE '' END)",
        "lb_type": "CASE WHEN c_custkey % 10 = 3 AND c_acctbal > 3000 THEN 'classic' ELSE '' END",
        "tags": tags.format(**one),
    }


def shaped(spark: SparkSession, folder: str, source: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, folder, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def shaped_sql(source: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


def trace(spark: SparkSession, folder: str) -> DataFrame:
    return shaped(spark, folder, "events", TRACE)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory as a stored table: its names would else be derived anew in every rule."""
    return materialize(shaped(spark, folder, "customer", inventory_columns(True)), "inventory")


TRACE_SQL = shaped_sql("events", TRACE)
INVENTORY_SQL = shaped_sql("customer", inventory_columns(False))
