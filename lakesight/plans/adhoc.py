"""Registered queries: the guarded SQL surface and the feature families it admits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.operators import sqlapi as Q
from lakesight.plans import derive as D
from lakesight.plans.registry import Registry
from lakesight.sources import tables as S

adhoc = Registry()


def register_views(spark: SparkSession, folder: str, sql: str) -> None:
    """Views for the tables the statement names."""
    for name in S.TABLES:
        if re.search(rf"\b{name}\b", sql):
            S.table(spark, folder, name).createOrReplaceTempView(name)


def select(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Rows of a guarded statement; a refusal is raised here."""
    register_views(spark, folder, sql)
    result = Q.run_select(spark, sql)
    if not result.success:
        raise ValueError(result.error)
    return result.rows


def statement(name: str, doc: str, sql: str, oracle: str | None = None) -> None:
    """Register one statement; the oracle is given where the dialects differ."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return select(spark, folder, sql)

    run.__doc__ = doc
    adhoc.register(oracle or sql.rstrip("; \n"), name=name)(run)


# ---- the guard ---------------------------------------------------------------------------------

STATEMENTS_SQL = D.shaped_sql("events", D.STATEMENTS)


def guard_sql(hit: Callable[[str], str], calls: bool) -> str:
    rules = " ".join(f"WHEN {hit(w)} THEN 'Dangerous SQL keyword ''{w}'' is not allowed'" for w in Q.REFUSED_WORDS)
    tail = (
        " ".join(f"WHEN regexp_matches(replace(u, '`', ''), '\\b{w}\\b') THEN 'Function ''{w}'' is not allowed'" for w in Q.REFUSED_CALLS)
        + f" WHEN regexp_matches(replace(u, '`', ''), '{Q.FILE_RELATION}') THEN '{Q.ERROR_FILE}'"
        if calls else ""
    )
    return f"""SELECT stmt_id, CASE WHEN sql = '' THEN 'SQL query is required' {rules}
WHEN NOT starts_with(u, 'SELECT') THEN 'Only SELECT queries are allowed' {tail} END AS error
FROM (SELECT *, trim(upper(sql)) AS u FROM ({STATEMENTS_SQL}))"""


@adhoc.register(guard_sql(lambda w: f"contains(u, '{w}')", False))
def statement_guard_substring(spark: SparkSession, folder: str) -> DataFrame:
    """Which statements are refused when words match as substrings."""
    rows = D.shaped(spark, folder, "events", D.STATEMENTS)
    return rows.select("stmt_id", Q.guard_error(F.col("sql"), "substring").alias("error"))


@adhoc.register(guard_sql(lambda w: f"regexp_matches(u, '\\b{w}\\b')", True))
def statement_guard_words(spark: SparkSession, folder: str) -> DataFrame:
    """Which statements are refused when whole words match."""
    rows = D.shaped(spark, folder, "events", D.STATEMENTS)
    return rows.select("stmt_id", Q.guard_error(F.col("sql")).alias("error"))


# ---- rows as JSON ------------------------------------------------------------------------------

@adhoc.register("""SELECT '{"l_orderkey":' || l_orderkey || ',"price":' || CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS VARCHAR)
|| ',"shipped":"' || strftime(l_shipdate, '%Y-%m-%d') || '","at":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')
|| '","note":' || CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '"' END || '}' AS json FROM lineitem""")
def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON objects: decimals as numbers, dates and times as ISO text."""
    rows = S.table(spark, folder, "lineitem").select(
        "l_orderkey",
        S.price().alias("price"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        F.col("l_shipdate").alias("at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("note"),
    )
    return Q.json_rows(rows)


# ---- statement families ----------------------------------------------------------------------------

statement("sql_count", "A count over one brand.", """
SELECT COUNT(*) AS total_sales FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#7';""")

statement("sql_inner_join", "Inner joins over four tables.", """
SELECT n_name, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name, o_orderpriority""",
          """SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name, o_orderpriority""")

statement("sql_left_join", "A left join that keeps customers without orders.", """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
AND o_orderstatus = 'P' GROUP BY c_custkey""")

statement("sql_full_join", "A full join of two aggregates.", """
SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey) c
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k""")

statement("sql_semi_join", "EXISTS as a semi join.", """
SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")

statement("sql_anti_join", "NOT EXISTS as an anti join.", """
SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)""")

statement("sql_in_subquery", "Membership in a subquery.", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")

statement("sql_theta_join", "An equality with a comparison across tables.", """
SELECT o_orderpriority, count(*) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate
GROUP BY o_orderpriority""")

statement("sql_self_join", "A table joined to an aggregate of itself.", """
SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) m
ON m.o_custkey = o.o_custkey AND m.top = o.o_totalprice""")

statement("sql_correlated_scalar", "A scalar subquery per group.", """
SELECT c_mktsegment, count(*) AS n FROM customer c WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
GROUP BY c_mktsegment""")

statement("sql_having_filter", "DISTINCT, FILTER and HAVING.", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 100""")

statement("sql_grouping_sets", "Chosen groupings in one statement.", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderpriority) AS g, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""", """
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS TINYINT) AS g, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")

statement("sql_rollup", "Subtotals along one hierarchy.", """
SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")

statement("sql_cube", "Every combination of two keys.", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)""")

statement("sql_percentiles", "Interpolated percentiles per group.", """
SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median,
percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY l_returnflag""", """
SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag""")

statement("sql_string_agg", "Distinct values joined in order.", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',') WITHIN GROUP (ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey""", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey""")

statement("sql_approx_distinct", "Distinct parts: the exact count wherever the approximate one is within a tenth of it.", """
SELECT l_returnflag, CASE WHEN abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey)
  THEN count(DISTINCT l_partkey) ELSE approx_count_distinct(l_partkey) END AS parts
FROM lineitem GROUP BY l_returnflag""", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")

statement("sql_window_ranks", "Ranks, neighbours and running totals over monthly sums.", """
SELECT status, month, n, rank() OVER (PARTITION BY status ORDER BY n DESC) AS place,
lag(n) OVER (PARTITION BY status ORDER BY month) AS previous,
sum(n) OVER (PARTITION BY status ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
FROM (SELECT o_orderstatus AS status, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2)""", """
SELECT status, month, n, rank() OVER (PARTITION BY status ORDER BY n DESC) AS place,
lag(n) OVER (PARTITION BY status ORDER BY month) AS previous,
CAST(sum(n) OVER (PARTITION BY status ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM (SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2)""")

statement("sql_top_per_group", "The three dearest orders of every priority.", """
SELECT o_orderpriority, o_orderkey, place FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
WHERE place <= 3""", """
SELECT o_orderpriority, o_orderkey, CAST(place AS INTEGER) AS place FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
WHERE place <= 3""")

statement("sql_union", "UNION drops duplicates.", """
SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier""")

statement("sql_union_all", "UNION ALL keeps duplicates.", """
SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier""")

statement("sql_intersect", "Keys in both tables.", """
SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")

statement("sql_except", "Keys in one table only.", """
SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")

statement("sql_case_like", "CASE with LIKE, grouped by its alias.", """
SELECT CASE WHEN p_name LIKE '%bolt%' THEN 'Bolts' WHEN p_name LIKE 'red%' THEN 'Red' ELSE 'Other' END AS family, count(*) AS n
FROM part GROUP BY family ORDER BY n DESC LIMIT 2""")

statement("sql_limit_offset", "Order, limit and offset.", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40;""")
