"""Registered queries: load, table maintenance and the snapshot lane."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakesight.functions import cleaning
from lakesight.operators import keyed
from lakesight.operators.embed import hashing_embedder
from lakesight.plans import load, snapshot as snap
from lakesight.plans.registry import Registry
from lakesight.plans.retail import AVG_PRICE, SALES, SUM_PRICE
from lakesight.session import scratch_folder as scratch
from lakesight.sources import csv_files, tables as S
from lakesight.sources.store import TableStore, load_once, vector_report, write_summary

batch = Registry()

RUN_AT = datetime(2026, 1, 16, 5, 33, 5, 39918, tzinfo=timezone.utc)


# ---- load ---------------------------------------------------------------------------------

def order_file(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a raw sales file: texts with quotes and breaks, ratings of every kind, missing tokens."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return S.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("ID"),
        F.col("o_custkey").cast("string").alias("CUSTOMER_ID"),
        F.when(priority == "5-LOW", "N/A").when(priority == "1-URGENT", "null").otherwise(priority).alias("BRAND"),
        status.alias("FRIDGE_MODEL"),
        F.lit("350.5").alias("CAPACITY_LITERS"),
        F.format_string("%.2f", "o_totalprice").alias("PRICE"),
        F.col("o_orderdate").cast("date").cast("string").alias("SALES_DATE"),
        F.concat(F.lit('Store "'), status, F.lit('", main')).alias("STORE_NAME"),
        F.when(status == "P", "<NA>").otherwise("1 Main St, Boston, MA").alias("STORE_ADDRESS"),
        F.concat(F.lit("line one of "), F.col("o_orderkey"), F.lit("\nline two, quoted \"so\"")).alias("CUSTOMER_FEEDBACK"),
        F.when(status == "F", "4").when(status == "O", "4.0").when(priority == "3-MEDIUM", "x").otherwise(" 7 ")
        .alias("FEEDBACK_RATING"),
        F.when(status == "P", "").otherwise("Neutral").alias("FEEDBACK_SENTIMENT_CATEGORY"),
    )


@batch.register("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer_id,
  CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN NULL ELSE o_orderpriority END AS brand,
  o_orderstatus AS fridge_model, CAST(350.5 AS DECIMAL(10,2)) AS capacity_liters,
  CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS sales_date,
  'Store "' || o_orderstatus || '", main' AS store_name,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '1 Main St, Boston, MA' END AS store_address,
  'line one of ' || o_orderkey || chr(10) || 'line two, quoted "so"' AS customer_feedback,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderstatus = 'O' THEN NULL
       WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 7 END AS INTEGER) AS feedback_rating,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Neutral' END AS feedback_sentiment_category
FROM orders""")
def csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as raw CSV files, read back with the header check, cleaned, last row per id."""
    path = scratch(spark, "csv")
    order_file(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    rows = csv_files.clean_raw(csv_files.read_raw_csv(spark, path))
    return csv_files.last_in_file(rows)


@batch.register("""
SELECT line FROM (SELECT 'RAW_COUNT=' || count(*) AS line FROM orders UNION ALL SELECT 'EMBEDDINGS_COUNT=' || count(*) FROM orders)
UNION ALL SELECT 'changed ' || id || ' ' || brand || ' ' || price FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Unknown' AS brand, CAST(c_acctbal AS DECIMAL(18,2)) AS price
  FROM customer JOIN orders ON o_orderkey = c_custkey * 20 WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING')
UNION ALL SELECT 'unknown ' || (c_custkey * 20) FROM customer WHERE c_acctbal >= 0 AND c_custkey * 20 NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'left ' || count(*) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey * 20 FROM customer WHERE c_mktsegment = 'BUILDING')""")
def load_and_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Files to raw table to vectors, then edits and deletes that touch only their rows."""
    path = scratch(spark, "load")
    store, embed = TableStore(spark, f"{path}/store"), hashing_embedder()
    order_file(spark, folder).write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    raw, _ = load.load_raw(store, f"{path}/csv")
    vectors, _ = load.load_vectors(store, embed, 64)
    lines = load.announce(raw, vectors)

    customer = S.table(spark, folder, "customer").withColumn("id", (F.col("c_custkey") * 20).cast("string"))
    edits = customer.where("c_acctbal >= 0").select("id", F.col("c_acctbal").cast("decimal(18,2)").alias("price"))
    missing = load.update_rows(store, edits, embed)
    load.delete_ids(store, customer.where("c_mktsegment = 'BUILDING'"))
    left = store.compact(load.RAW)
    paired = left.join(store.current(load.VECTORS).select("id", F.size("embedding").alias("size")), "id").where("size = 64")
    changed = paired.where("brand = 'Unknown'").select(F.concat_ws(" ", F.lit("changed"), "id", "brand", "price").alias("line"))
    return (
        lines.unionByName(changed)
        .unionByName(missing.select(F.concat_ws(" ", F.lit("unknown"), "id").alias("line")))
        .unionByName(paired.agg(F.concat_ws(" ", F.lit("left"), F.count("*")).alias("line")))
    )


@batch.register("""
SELECT o_orderkey, CASE WHEN v IN ('', 'N/A', 'NaN', 'null') THEN NULL ELSE v END AS value,
       CASE WHEN lower(v) IN ('', 'nan') THEN NULL ELSE v END AS literal_value,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 12 END AS as_int,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(trunc(o_totalprice) AS INTEGER) END AS cut_int,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderstatus = 'O' THEN 'true' END AS union_value
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN 'N/A' WHEN '3-MEDIUM' THEN 'NaN'
        WHEN '4-NOT SPECIFIED' THEN ' 12 ' ELSE 'null' END AS v FROM orders)""")
def cleaned_values(spark: SparkSession, folder: str) -> DataFrame:
    """Missing tokens, literal cleaning, safe integers and tagged unions over all orders."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    text = (
        F.when(priority == "1-URGENT", "").when(priority == "2-HIGH", "N/A").when(priority == "3-MEDIUM", "NaN")
        .when(priority == "4-NOT SPECIFIED", " 12 ").otherwise("null")
    )
    number = F.when(priority == "1-URGENT", float("nan")).otherwise(F.col("o_totalprice"))
    tagged = F.struct(
        (status == "P").alias("is_null"),
        F.lit(None).cast("string").alias("string_value"),
        F.when(status != "O", F.col("o_orderkey")).alias("long_value"),
        F.lit(None).cast("double").alias("double_value"),
        F.when(status == "O", True).alias("boolean_value"),
    )
    return S.table(spark, folder, "orders").select(
        "o_orderkey",
        cleaning.na_to_null(text).alias("value"),
        cleaning.sql_literal_value(text).alias("literal_value"),
        cleaning.safe_int(text).alias("as_int"),
        cleaning.safe_int(cleaning.sql_literal_value(number, is_text=False)).alias("cut_int"),
        cleaning.union_field(tagged).alias("union_value"),
    )


@batch.register("""
SELECT 'first' AS attempt, true AS written, count(*) AS n FROM customer
UNION ALL SELECT 'second', false, count(*) FROM customer
UNION ALL SELECT 'forced', true, count(*) FROM supplier""")
def idempotent_load(spark: SparkSession, folder: str) -> DataFrame:
    """A load is skipped when the target holds rows, unless forced."""
    store = TableStore(spark, scratch(spark, "store"))
    customer, supplier = S.table(spark, folder, "customer"), S.table(spark, folder, "supplier")
    steps = [("first", customer, False), ("second", supplier, False), ("forced", supplier, True)]
    result = None
    for attempt, rows, force in steps:
        stored, written = load_once(store, "target", lambda rows=rows: rows, force)
        row = stored.agg(F.count("*").alias("n")).select(F.lit(attempt).alias("attempt"), F.lit(written).alias("written"), "n")
        result = row if result is None else result.unionByName(row)
    return result


@batch.register("SELECT true AS has_column, count(*) AS n_rows, count(*) FILTER (WHERE len(embedding) <> 64) AS n_bad FROM embeddings")
def vector_schema_check(spark: SparkSession, folder: str) -> DataFrame:
    """The vector column is present and all its values have the right length."""
    return vector_report(S.table(spark, folder, "embeddings"), 64)


# ---- keyed maintenance ----------------------------------------------------------------------

ROW_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
ROW_SQL = ", ".join(f"{c} DESC" for c in ROW_ORDER)
LINE_COLUMNS = "id, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_linestatus"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "lineitem").withColumn("id", S.sale_id())


@batch.register(f"""
SELECT {LINE_COLUMNS} FROM (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber) AS id,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ROW_SQL}, l_linestatus DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def last_write_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last line of each repeated id."""
    rows = keyed.last_write_wins(lines(spark, folder), "id", [*ROW_ORDER, "l_linestatus"])
    return rows.select(*LINE_COLUMNS.split(", "))


@batch.register(f"""
WITH ranked AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber) AS id,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_linestatus ORDER BY {ROW_SQL}) AS rn FROM lineitem),
target AS (SELECT {LINE_COLUMNS} FROM ranked WHERE rn = 1 AND l_linestatus = 'F'),
source AS (SELECT {LINE_COLUMNS} FROM ranked WHERE rn = 1 AND l_linestatus = 'O')
SELECT * FROM target WHERE id NOT IN (SELECT id FROM source) UNION ALL SELECT * FROM source""")
def upsert_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Open lines upserted into finished ones."""
    rows = lines(spark, folder)
    newest = keyed.last_write_wins(rows, ["id", "l_linestatus"], ROW_ORDER).select(*LINE_COLUMNS.split(", "))
    return keyed.upsert(newest.where("l_linestatus = 'F'"), newest.where("l_linestatus = 'O'"))


def order_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a raw table with a unique text key."""
    return S.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("brand"),
        F.col("o_orderstatus").alias("fridge_model"),
        F.lit(None).cast("decimal(10,2)").alias("capacity_liters"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("sales_date"),
        F.lit("Main").alias("store_name"),
        F.lit("").alias("store_address"),
        F.lit("").alias("customer_feedback"),
        F.lit(None).cast("int").alias("feedback_rating"),
        F.lit("Neutral").alias("feedback_sentiment_category"),
    )


ORDER_SALES_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS brand,
  o_orderstatus AS fridge_model, CAST(NULL AS DECIMAL(10,2)) AS capacity_liters,
  CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS sales_date, 'Main' AS store_name,
  '' AS store_address, '' AS customer_feedback, CAST(NULL AS INTEGER) AS feedback_rating,
  'Neutral' AS feedback_sentiment_category FROM orders"""
EDITS_SQL = """
SELECT CAST(c_custkey * 20 AS VARCHAR) AS id, '' AS customer_id, c_mktsegment AS brand, 'Unknown' AS fridge_model,
  CAST(NULL AS DECIMAL(10,2)) AS capacity_liters,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS price, CAST(NULL AS DATE) AS sales_date,
  'Unknown' AS store_name, '' AS store_address, '' AS customer_feedback, CAST(NULL AS INTEGER) AS feedback_rating,
  'Neutral' AS feedback_sentiment_category FROM customer"""


def customer_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits that name some fields only; half of their keys exist."""
    return keyed.full_rows(
        S.table(spark, folder, "customer").select(
            (F.col("c_custkey") * 20).cast("string").alias("id"),
            F.col("c_mktsegment").alias("brand"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("decimal(18,2)")).alias("price"),
        )
    )


@batch.register(f"""
WITH target AS ({ORDER_SALES_SQL}), edits AS ({EDITS_SQL})
SELECT * FROM target WHERE id NOT IN (SELECT id FROM edits)
UNION ALL SELECT * FROM edits WHERE id IN (SELECT id FROM target)""")
def full_row_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits replace whole rows: fields they leave out take defaults."""
    return keyed.replace_rows(order_sales(spark, folder), customer_edits(spark, folder)).table


@batch.register(f"""
WITH target AS ({ORDER_SALES_SQL}), edits AS ({EDITS_SQL})
SELECT id FROM edits WHERE id NOT IN (SELECT id FROM target)""")
def edits_not_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of edits that match no row."""
    return keyed.replace_rows(order_sales(spark, folder), customer_edits(spark, folder)).not_found


@batch.register(f"""
WITH raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders),
vec AS (SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings UNION ALL SELECT 'v' || vec_id FROM embeddings),
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION SELECT 'v' || c_custkey FROM customer),
found AS (SELECT id FROM ids WHERE id IN (SELECT id FROM raw))
SELECT 'raw' AS "table", id FROM raw WHERE id NOT IN (SELECT id FROM found)
UNION ALL SELECT 'embeddings', id FROM vec WHERE id NOT IN (SELECT id FROM found)
UNION ALL SELECT 'not_found', id FROM ids WHERE id NOT IN (SELECT id FROM raw)""")
def delete_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes reach the dependent table only where the raw table knows the key."""
    vectors = S.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    keys = S.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    prefixed = lambda df: df.select(F.concat(F.lit("v"), "id").alias("id"))
    result = keyed.delete_rows(
        order_sales(spark, folder).select("id"), vectors.unionByName(prefixed(vectors)), keys.unionByName(prefixed(keys))
    )
    return (
        result.raw.select(F.lit("raw").alias("table"), "id")
        .unionByName(result.embeddings.select(F.lit("embeddings").alias("table"), "id"))
        .unionByName(result.not_found.select(F.lit("not_found").alias("table"), "id"))
    )


@batch.register(f"""
WITH before AS ({ORDER_SALES_SQL}), edits AS ({EDITS_SQL}),
after AS (SELECT * FROM before WHERE id NOT IN (SELECT id FROM edits)
          UNION ALL SELECT * FROM edits WHERE id IN (SELECT id FROM before))
SELECT id FROM (SELECT * FROM after EXCEPT SELECT * FROM before)""")
def changed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys whose row an edit really changed: what has to be embedded again."""
    before = order_sales(spark, folder)
    after = keyed.replace_rows(before, customer_edits(spark, folder)).table
    return keyed.changed_rows(before, after).select("id")


@batch.register(f"SELECT * FROM ({ORDER_SALES_SQL}) ORDER BY id LIMIT 25 OFFSET 200")
def order_page(spark: SparkSession, folder: str) -> DataFrame:
    """The ninth page of 25 rows in key order."""
    return keyed.page(order_sales(spark, folder), "id", 25, 200).rows


@batch.register(f"""
WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_shipdate FROM lineitem WHERE l_linenumber > 2),
t AS (SELECT DISTINCT CASE WHEN k % 97 = 0 THEN NULL ELSE k END AS key FROM k)
SELECT key, (SELECT count(*) FROM t) AS total FROM t ORDER BY key NULLS LAST LIMIT 40 OFFSET 3000""")
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far behind the first, over numbers with a missing one, and the total."""
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    keys = S.table(spark, folder, "lineitem").where("l_linenumber > 2").select(
        F.when(number % 97 != 0, number).alias("key")).distinct()
    found = keyed.page(keys, "key", 40, 3000)
    return found.rows.withColumn("total", F.lit(found.total).cast("long"))


@batch.register(f"SELECT * FROM ({ORDER_SALES_SQL}) WHERE id > '1200' ORDER BY id LIMIT 25")
def order_page_after(spark: SparkSession, folder: str) -> DataFrame:
    """The page of 25 rows that follows a key."""
    return keyed.page_after(order_sales(spark, folder), "id", "1200", 25)


@batch.register("""
SELECT doc_id, lang, source, label, len(embedding) AS dimension FROM documents JOIN embeddings ON doc_id = vec_id""")
def feedback_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each feedback text paired with its vector."""
    return S.feedback(spark, folder).select("doc_id", "lang", "source", "label", F.size("embedding").alias("dimension"))


# ---- snapshot lane ----------------------------------------------------------------------------

def batch_run(spark: SparkSession, folder: str, scope: str = "kube") -> tuple[TableStore, DataFrame]:
    store = TableStore(spark, scratch(spark, "store"))
    sales = S.sales(
        spark, folder, "id", "brand", "fridge_model", "price", "sales_date", "store_name", "feedback_sentiment_category"
    )
    return store, snap.run_batch(store, sales, RUN_AT, scope, source=S.table(spark, folder, "lineitem"))


TOP8 = f"""{SALES},
b AS (SELECT 'brand' AS section, brand AS name, '' AS detail, count(*) AS n, {SUM_PRICE} AS revenue,
        {AVG_PRICE} AS average, CAST(NULL AS DECIMAL(5,2)) AS rate,
        row_number() OVER (ORDER BY count(*) DESC, brand) - 1 AS position FROM sales GROUP BY brand),
s AS (SELECT 'store', store_name, '', count(*), {SUM_PRICE}, {AVG_PRICE},
        CAST(CAST(count(*) FILTER (WHERE feedback_sentiment_category = 'Negative') AS DOUBLE)
             / CAST(count(*) AS DOUBLE) * 100 AS DECIMAL(5,2)),
        row_number() OVER (ORDER BY sum(price) DESC, store_name) - 1 FROM sales GROUP BY store_name),
m AS (SELECT 'model', brand, fridge_model, count(*), {SUM_PRICE}, {AVG_PRICE}, NULL,
        row_number() OVER (ORDER BY count(*) DESC, brand, fridge_model) - 1 FROM sales GROUP BY brand, fridge_model),
f AS (SELECT 'feedback', brand, feedback_sentiment_category, count(*), NULL, NULL, NULL,
        row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, feedback_sentiment_category) - 1
      FROM sales GROUP BY brand, feedback_sentiment_category),
every AS (SELECT * FROM b UNION ALL SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT * FROM f)
SELECT section, CAST(position AS INTEGER) AS position, name, detail, n, revenue, average, rate FROM every
WHERE section = 'feedback' OR position < 8"""


@batch.register(TOP8)
def analytics_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A full batch run, then its newest snapshot parsed, trimmed for serving and listed row by row."""
    store, snapshots = batch_run(spark, folder)
    kinds = "struct<section:string,position:int,name:string,detail:string,n:bigint,revenue:decimal(28,2),average:double,rate:decimal(5,2)>"

    def listed(section: str, column: str, name: str, detail: str | None, n: str, average: str, rate: str | None):
        return F.transform(column, lambda r, i: F.struct(
            F.lit(section), i, r[name], r[detail] if detail else F.lit(""), r[n], r["total_revenue"], r[average],
            r[rate] if rate else F.lit(None)).cast(kinds))

    # The top lists leave the row together, so it is read and parsed once.
    lists = F.concat(
        listed("brand", "sales_by_brand", "brand", None, "total_sales", "avg_price", None),
        listed("store", "store_performance", "store_name", None, "total_sales", "avg_sale_price", "negative_feedback_rate"),
        listed("model", "top_models", "brand", "fridge_model", "sales_count", "avg_price", None),
    )
    rank = Window.partitionBy("brand").orderBy(F.col("count").desc(), "feedback_sentiment_category")
    feedback = snap.latest_feedback(store, snapshots).select(
        F.lit("feedback").alias("section"), (F.row_number().over(rank) - 1).alias("position"), F.col("brand").alias("name"),
        F.col("feedback_sentiment_category").alias("detail"), F.col("count").alias("n"),
        F.lit(None).cast("decimal(28,2)").alias("revenue"), F.lit(None).cast("double").alias("average"),
        F.lit(None).cast("decimal(5,2)").alias("rate"),
    )
    return snap.serve(snapshots, 300).select(F.inline(lists)).unionByName(feedback)


@batch.register(f"""{SALES}
SELECT count(*) AS total_records, {SUM_PRICE} AS total_revenue, {AVG_PRICE} AS mean_price,
  '2026-01-16T05:33:05.039918Z' AS last_updated_at, CAST(5 AS BIGINT) AS analytics_run_interval_minutes,
  'kube' AS updated_by_scope FROM sales""")
def snapshot_header(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, update time, run interval and writer of the newest snapshot."""
    _, snapshots = batch_run(spark, folder)
    return snap.serve(snapshots, 300).select(
        "total_records", "total_revenue", F.col("price_stats.mean_price").alias("mean_price"),
        "last_updated_at", "analytics_run_interval_minutes", "updated_by_scope",
    )


@batch.register(f"""{SALES}
SELECT count(*) AS total_records, CAST({SUM_PRICE} AS DOUBLE) AS total_revenue, {AVG_PRICE} AS avg_price,
  '2026-01-16T05:33:05.039918Z' AS last_updated FROM sales""")
def snapshot_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The one-row summary, written as JSON and read back."""
    _, snapshots = batch_run(spark, folder)
    path = scratch(spark, "summary")
    write_summary(snap.summary(snapshots), path)
    return spark.read.schema("total_records long, total_revenue double, avg_price double, last_updated string").json(path)


@batch.register("""
SELECT 'local' AS provider, 'kube' AS scope, endpoint, true AS ok,
       'count=' || n || ' expected=' || n AS notes
FROM (SELECT count(*) AS n FROM lineitem), (VALUES ('source'), ('copy'), ('snapshot')) AS t(endpoint)""")
def layer_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of source, batch copy and snapshot, as quality report rows."""
    store, snapshots = batch_run(spark, folder)
    counts = snap.layer_counts({
        "source": S.table(spark, folder, "lineitem").select("l_orderkey"),
        "copy": store.read("sales").select("id"),
    })
    saved = snap.saved_total(snapshots).select(F.lit("snapshot").alias("layer"), F.col("saved_total").alias("n"))
    return snap.report_rows(snap.count_check(counts.unionByName(saved), "source"), "local", "kube")
