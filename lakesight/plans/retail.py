"""Registered queries: rollups and questions over the sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions import cleaning, formats, places
from lakesight.operators import rollups as R
from lakesight.plans.registry import Registry
from lakesight.sources import tables as S

retail = Registry()

# ---- SQL fragments of the oracles ---------------------------------------------------

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
TONE = "CASE l_returnflag WHEN 'R' THEN 'Negative' WHEN 'A' THEN 'Positive' ELSE 'Neutral' END"
RATING = "CAST(CAST(l_quantity AS INTEGER) % 10 + 1 AS INTEGER)"
MODEL = "concat_ws(' ', p_type, p_name)"
ADDRESS = (
    "concat_ws(', ', n_name, CASE n_regionkey WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Chicago, IL' "
    "WHEN 2 THEN 'Los Angeles, CA' WHEN 3 THEN 'Houston, TX' ELSE 'Elsewhere' END)"
)
REGION_CASE = (
    "CASE WHEN store_address LIKE '%New York%' OR store_address LIKE '%Boston%' THEN 'Northeast' "
    "WHEN store_address LIKE '%Chicago%' OR store_address LIKE '%Detroit%' THEN 'Midwest' "
    "WHEN store_address LIKE '%Los Angeles%' OR store_address LIKE '%San Francisco%' THEN 'West' "
    "WHEN store_address LIKE '%Houston%' OR store_address LIKE '%Miami%' THEN 'South' ELSE 'Other' END"
)
SALES = f"""
WITH sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS id, CAST(o_custkey AS VARCHAR) AS customer_id,
         p_brand AS brand, {MODEL} AS fridge_model, CAST(p_size AS DECIMAL(10,2)) AS capacity_liters,
         {PRICE} AS price, CAST(l_shipdate AS DATE) AS sales_date, s_name AS store_name,
         {ADDRESS} AS store_address,
         concat_ws(' ', {TONE}, 'feedback on order', l_orderkey) AS customer_feedback,
         {RATING} AS feedback_rating, {TONE} AS feedback_sentiment_category
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
)
"""
SUM_PRICE = "CAST(sum(price) AS DECIMAL(28,2))"
AVG_PRICE = "CAST(sum(price) AS DOUBLE) / CAST(count(*) AS DOUBLE)"


# ---- partials of the fact table with one dimension ------------------------------------------

def facts(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        S.price().alias("price"),
        F.col("l_shipdate").cast("date").alias("sales_date"),
        R.month_of(F.col("l_shipdate").cast("date")).alias("month"),
        S.rating().alias("feedback_rating"),
        S.sentiment().alias("feedback_sentiment_category"),
    )


MEASURES = ("price", "feedback_sentiment_category")


def brand_parts(spark: SparkSession, folder: str, *group: str, measures: tuple[str, ...] = ("price",)) -> DataFrame:
    """Partials per group out of brand, model, month and sentiment."""
    rows = facts(spark, folder)
    dimension = S.brands(spark, folder)
    own = [g for g in group if g in rows.columns]
    wanted = [c for c in dimension.columns if c in group]
    return R.by_dimension(
        rows.select("l_partkey", *dict.fromkeys([*own, *measures])), dimension.select("l_partkey", *wanted),
        "l_partkey", *group,
    )


def store_parts(spark: SparkSession, folder: str, *group: str) -> DataFrame:
    """Partials per group out of store, address and month."""
    rows = facts(spark, folder)
    dimension = S.stores(spark, folder)
    own = [g for g in group if g in rows.columns]
    wanted = [c for c in dimension.columns if c in group]
    return R.by_dimension(
        rows.select("l_suppkey", *dict.fromkeys([*own, *MEASURES])), dimension.select("l_suppkey", *wanted),
        "l_suppkey", *group,
    )


# ---- rollups --------------------------------------------------------------------------

@retail.register(f"""{SALES}
SELECT brand, count(*) AS total_sales, {SUM_PRICE} AS total_revenue, {AVG_PRICE} AS avg_price,
       min(price) AS min_price, max(price) AS max_price
FROM sales GROUP BY brand ORDER BY total_sales DESC, brand LIMIT 20""")
def sales_by_brand(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 brands by number of sales."""
    return R.sales_by_brand(brand_parts(spark, folder, "brand"))


@retail.register(f"""{SALES}
SELECT store_name, count(*) AS total_sales, {SUM_PRICE} AS total_revenue, {AVG_PRICE} AS avg_sale_price,
       count(*) FILTER (WHERE feedback_sentiment_category = 'Negative') AS negative_feedback_count,
       count(*) FILTER (WHERE feedback_sentiment_category = 'Positive') AS positive_feedback_count,
       CAST(CAST(count(*) FILTER (WHERE feedback_sentiment_category = 'Negative') AS DOUBLE)
            / CAST(count(*) AS DOUBLE) * 100 AS DECIMAL(5,2)) AS negative_feedback_rate
FROM sales GROUP BY store_name ORDER BY total_revenue DESC, store_name LIMIT 20""")
def store_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 stores by revenue with their share of negative feedback."""
    return R.store_performance(store_parts(spark, folder, "store_name"))


@retail.register(f"""{SALES}
SELECT brand, feedback_sentiment_category, count(*) AS "count"
FROM sales GROUP BY ALL ORDER BY brand, "count" DESC""")
def feedback_by_brand(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback counts per brand and sentiment, in display order."""
    return R.feedback_by_brand(brand_parts(spark, folder, "brand", "feedback_sentiment_category", measures=()))


@retail.register(f"""{SALES}
SELECT brand, fridge_model, count(*) AS sales_count, {SUM_PRICE} AS total_revenue, {AVG_PRICE} AS avg_price
FROM sales GROUP BY brand, fridge_model ORDER BY sales_count DESC, brand, fridge_model LIMIT 20""")
def top_models(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 models by number of sales."""
    return R.top_models(brand_parts(spark, folder, "brand", "fridge_model"))


@retail.register(f"""{SALES}
SELECT count(*) AS total_records, coalesce({SUM_PRICE}, 0) AS total_revenue, {AVG_PRICE} AS mean_price,
       CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price FROM sales""")
def sales_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Count, revenue and price statistics in one pass."""
    return R.totals(facts(spark, folder).select("price"))


@retail.register("SELECT count(*) AS total_records FROM lineitem")
def sales_row_count(spark: SparkSession, folder: str) -> DataFrame:
    """Number of sales."""
    return R.row_count(S.table(spark, folder, "lineitem"))


@retail.register(f"""{SALES}
SELECT {AVG_PRICE} AS mean_price, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price
FROM sales""")
def price_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, lowest and highest price."""
    return R.price_stats(facts(spark, folder).select("price"))


@retail.register(f"SELECT CAST(sum({PRICE}) AS DECIMAL(28,2)) AS total_revenue FROM lineitem")
def total_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of all sales."""
    return R.total_revenue(facts(spark, folder).select("price"))


@retail.register(f"""
SELECT CAST(sum({RATING}) AS DOUBLE) / CAST(count({RATING}) AS DOUBLE) AS avg_rating, count({RATING}) AS n_ratings
FROM lineitem""")
def average_rating(spark: SparkSession, folder: str) -> DataFrame:
    """Average customer rating over all sales."""
    return R.average_rating(facts(spark, folder))


@retail.register(f"""SELECT {TONE} AS feedback_sentiment_category, count(*) AS "count" FROM lineitem GROUP BY 1""")
def sentiment_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of sales per sentiment."""
    return R.sentiment_counts(facts(spark, folder))


@retail.register(f"""{SALES}
SELECT {REGION_CASE} AS region, {SUM_PRICE} AS total_sales FROM sales
GROUP BY 1 ORDER BY total_sales DESC, region LIMIT 1""")
def biggest_region(spark: SparkSession, folder: str) -> DataFrame:
    """The region with the highest revenue."""
    return R.revenue_by_region(store_parts(spark, folder, "store_address"), 1)


@retail.register(f"""{SALES}
SELECT {REGION_CASE} AS region, {SUM_PRICE} AS total_sales FROM sales GROUP BY 1""")
def revenue_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of every region."""
    return R.revenue_by_region(store_parts(spark, folder, "store_address"), None)


@retail.register(f"""{SALES}
SELECT brand, CAST(date_trunc('month', sales_date) AS DATE) AS month, count(*) AS total_sales,
       {SUM_PRICE} AS total_revenue FROM sales GROUP BY 1, 2""")
def monthly_brand_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales per brand and calendar month."""
    return R.monthly_brand_sales(brand_parts(spark, folder, "brand", "month"))


LAST_MONTH_AS_OF = "1998-06-15"


@retail.register(f"""{SALES}
SELECT brand, count(*) AS total_sales FROM sales
WHERE sales_date >= DATE '1998-05-01' AND sales_date < DATE '1998-06-01' GROUP BY brand""")
def brand_sales_last_month(spark: SparkSession, folder: str) -> DataFrame:
    """Sales per brand in the month before a given day."""
    recent = facts(spark, folder).where(
        R.previous_month(F.col("sales_date"), F.to_date(F.lit(LAST_MONTH_AS_OF)))
    )
    brand = S.brands(spark, folder).select("l_partkey", "brand")
    parts = R.by_dimension(recent.select("l_partkey"), brand, "l_partkey", "brand")
    return parts.select("brand", F.col("n").alias("total_sales"))


@retail.register(f"""{SALES},
monthly AS (
  SELECT store_name, date_trunc('month', sales_date) AS month,
         CAST(CAST(count(*) FILTER (WHERE feedback_sentiment_category = 'Negative') AS DOUBLE)
              / CAST(count(*) AS DOUBLE) * 100 AS DECIMAL(5,2)) AS rate
  FROM sales GROUP BY 1, 2)
SELECT store_name, count(*) FILTER (WHERE rate >= 50) AS bad_months, count(*) AS active_months
FROM monthly GROUP BY 1 HAVING count(*) FILTER (WHERE rate >= 50) >= 12""")
def consistently_negative_stores(spark: SparkSession, folder: str) -> DataFrame:
    """Stores with at least half their feedback negative in twelve months or more."""
    return R.consistently_negative(store_parts(spark, folder, "store_name", "month"), 50, 12)


@retail.register(f"""{SALES}
SELECT store_name, {SUM_PRICE} AS total_sales FROM sales
GROUP BY store_name ORDER BY total_sales DESC, store_name LIMIT 3""")
def top_stores(spark: SparkSession, folder: str) -> DataFrame:
    """The three stores with the highest revenue."""
    return R.top_stores(store_parts(spark, folder, "store_name"), 3)


# ---- projections and predicates ---------------------------------------------------------

@retail.register(f"{SALES} SELECT * FROM sales")
def sales_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The denormalised sales table: facts joined to part, store, nation and order."""
    return S.sales(spark, folder)


@retail.register("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), 'Unknown')
AS brand, coalesce(nullif(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_name END, ''), 'Unknown') AS store_name,
coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END, 0) AS price,
'Neutral' AS feedback_sentiment_category, '' AS customer_feedback FROM customer""")
def batch_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Batch-path defaults: NULL and empty fields become their default."""
    balance = F.col("c_acctbal")
    rows = S.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(balance < 0, "").otherwise(F.col("c_mktsegment")).alias("brand"),
        F.when(F.col("c_nationkey") != 0, F.col("c_name")).alias("store_name"),
        F.when(balance >= 0, balance.cast("decimal(18,2)")).alias("price"),
        F.lit(None).cast("string").alias("feedback_sentiment_category"),
        F.lit("").alias("customer_feedback"),
    )
    return cleaning.batch_defaults(rows)


@retail.register("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS brand,
CASE WHEN c_nationkey = 0 THEN NULL ELSE c_name END AS store_name,
CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS price,
'' AS feedback_sentiment_category, '' AS customer_feedback FROM customer""")
def embed_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding-path defaults: only four text fields are filled."""
    balance = F.col("c_acctbal")
    rows = S.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(balance < 0, "").otherwise(F.col("c_mktsegment")).alias("brand"),
        F.when(F.col("c_nationkey") != 0, F.col("c_name")).alias("store_name"),
        F.when(balance >= 0, balance.cast("decimal(18,2)")).alias("price"),
        F.lit(None).cast("string").alias("feedback_sentiment_category"),
        F.lit(None).cast("string").alias("customer_feedback"),
    )
    return cleaning.embed_defaults(rows)


@retail.register(f"""
SELECT p_partkey, p_brand AS "BRAND", 0.0::DOUBLE AS price, 'Unknown' AS store_name,
       'Neutral' AS feedback_sentiment_category, 'Unknown' AS fridge_model FROM part""")
def missing_column_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Absent rollup columns are added as literals; an upper-case name counts as present."""
    rows = S.table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("BRAND"))
    return cleaning.add_missing_columns(rows)


@retail.register("""SELECT count(*) AS "count" FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#12'""")
def brand_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many sales of one brand."""
    sales = S.sales(spark, folder, "brand")
    return R.count_where(sales, F.col("brand") == "Brand#12")


@retail.register(f"SELECT count(*) AS \"count\" FROM lineitem WHERE {RATING} BETWEEN 8 AND 10")
def high_rating_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many sales were rated 8 to 10."""
    return R.count_where(facts(spark, folder), R.rating_between(8, 10))


@retail.register(f"""{SALES}
SELECT store_name, count(*) AS total_sales FROM sales
WHERE store_address LIKE '%New York%' OR store_address LIKE '%Houston%' GROUP BY store_name""")
def stores_by_address(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of the stores whose address contains one of two cities."""
    there = F.col("store_address").contains("New York") | F.col("store_address").like("%Houston%")
    sales = S.sales(spark, folder, "store_name", "store_address").where(there)
    return R.partials(sales, "store_name").select("store_name", F.col("n").alias("total_sales"))


@retail.register("SELECT * FROM orders WHERE o_orderkey = 7")
def order_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Point lookup by key; the predicate reaches the Parquet scan."""
    return S.table(spark, folder, "orders").where(F.col("o_orderkey") == 7)


# ---- scalar functions over whole tables -------------------------------------------------

@retail.register(f"""{SALES} SELECT id, store_address, {REGION_CASE} AS region FROM sales""")
def sale_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The sales region of every sale."""
    rows = S.sales(spark, folder, "id", "store_address")
    return rows.withColumn("region", places.sales_region(F.col("store_address")))


@retail.register("""SELECT o_orderkey,
CASE WHEN o_totalprice < 1000 THEN '-' ELSE '' END || '$' ||
  format('{:,}', CAST(round(abs(CASE WHEN o_totalprice < 1000 THEN -1 ELSE 1 END
    * CAST(o_totalprice AS DECIMAL(18,2))), 0) AS BIGINT)) AS price_text,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS ordered_at,
greatest(1, CAST(floor(o_totalprice / 60) AS BIGINT)) AS minutes,
CASE WHEN mins < 1 THEN 'Just now'
     WHEN mins < 60 THEN mins || CASE WHEN mins > 1 THEN ' minutes ago' ELSE ' minute ago' END
     WHEN mins // 60 < 24 THEN (mins // 60) || CASE WHEN mins // 60 > 1 THEN ' hours ago' ELSE ' hour ago' END
     ELSE (mins // 1440) || CASE WHEN mins // 1440 > 1 THEN ' days ago' ELSE ' day ago' END END AS age
FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '2000-01-01 12:30:00' - o_orderdate) / 60) AS BIGINT) AS mins FROM orders)""")
def order_display_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Display texts of an order: currency, ISO time, interval minutes and age."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    signed = F.when(F.col("o_totalprice") < 1000, -price).otherwise(price)
    as_of = F.lit("2000-01-01 12:30:00").cast("timestamp_ntz")
    return S.table(spark, folder, "orders").select(
        "o_orderkey",
        formats.whole_dollars(signed).alias("price_text"),
        formats.iso_utc(F.col("o_orderdate")).alias("ordered_at"),
        formats.interval_minutes(F.col("o_totalprice")).alias("minutes"),
        formats.relative_age(F.col("o_orderdate"), as_of).alias("age"),
    )


@retail.register(f"""
SELECT l_suppkey, CAST(CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100
       AS DECIMAL(5,2)) AS negative_rate,
       coalesce(CAST(min(CASE WHEN l_returnflag = 'R' THEN {PRICE} END) AS DOUBLE), 0.0) AS lowest_refund
FROM lineitem GROUP BY l_suppkey""")
def negative_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Half-up percentages and NULL-as-zero numbers for every supplier."""
    negative = F.col("feedback_sentiment_category") == "Negative"
    return facts(spark, folder).groupBy("l_suppkey").agg(
        formats.percentage(F.count_if(negative), F.count("*")).alias("negative_rate"),
        formats.zero_if_null(F.min(F.when(negative, F.col("price")))).alias("lowest_refund"),
    )
