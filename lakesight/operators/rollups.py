"""Batch rollups over the sales table.

Every rollup works on *partials*: counts, exact sums and extremes per key. They
combine to the same numbers as a direct aggregation, so they can also be built per
foreign key before a large dimension is joined; see :func:`by_dimension`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions.formats import mean, percentage, zero_if_null
from lakesight.functions.places import sales_region
from lakesight.schema import MONEY_SUM

TOP_COMPUTED = 20


def partials(sales: DataFrame, *keys: str | Column) -> DataFrame:
    """Counts, sums and extremes of the sales rows per key."""
    measures = [F.count("*").alias("n")]
    if "price" in sales.columns:
        measures += [
            F.sum("price").cast(MONEY_SUM).alias("revenue"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        ]
    if "feedback_sentiment_category" in sales.columns:
        tone = F.col("feedback_sentiment_category")
        measures += [
            F.count_if(tone == "Negative").alias("negative"),
            F.count_if(tone == "Positive").alias("positive"),
        ]
    return sales.groupBy(*keys).agg(*measures)


def combine(parts: DataFrame, *keys: str | Column) -> DataFrame:
    """Merge partials to coarser keys."""
    merged = {
        "n": F.sum("n"),
        "revenue": F.sum("revenue").cast(MONEY_SUM),
        "low": F.min("low"),
        "high": F.max("high"),
        "negative": F.sum("negative"),
        "positive": F.sum("positive"),
    }
    return parts.groupBy(*keys).agg(*[m.alias(c) for c, m in merged.items() if c in parts.columns])


def by_dimension(facts: DataFrame, dimension: DataFrame, key: str, *group: str) -> DataFrame:
    """Partials per group of a fact table joined to one dimension.

    The facts are folded per key before the join, with map-side combination, which takes
    the weight out of a key with very many rows; what meets the dimension is one row per
    key. How they meet is left to the adaptive plan, which knows both sizes by then.
    """
    own = [g for g in group if g in facts.columns]
    return combine(partials(facts, key, *own).join(dimension, key), *group)


def _top(df: DataFrame, n: int | None, by: str, *keys: str) -> DataFrame:
    """The n largest by a measure, ties broken by the keys."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])
    return ordered if n is None else ordered.limit(n)


def sales_by_brand(parts: DataFrame, n: int | None = TOP_COMPUTED) -> DataFrame:
    rows = combine(parts, "brand").select(
        "brand",
        F.col("n").alias("total_sales"),
        F.col("revenue").alias("total_revenue"),
        mean(F.col("revenue"), F.col("n")).alias("avg_price"),
        F.col("low").alias("min_price"),
        F.col("high").alias("max_price"),
    )
    return _top(rows, n, "total_sales", "brand")


def store_performance(parts: DataFrame, n: int | None = TOP_COMPUTED) -> DataFrame:
    rows = combine(parts, "store_name").select(
        "store_name",
        F.col("n").alias("total_sales"),
        F.col("revenue").alias("total_revenue"),
        mean(F.col("revenue"), F.col("n")).alias("avg_sale_price"),
        F.col("negative").alias("negative_feedback_count"),
        F.col("positive").alias("positive_feedback_count"),
        percentage(F.col("negative"), F.col("n")).alias("negative_feedback_rate"),
    )
    return _top(rows, n, "total_revenue", "store_name")


def feedback_by_brand(parts: DataFrame) -> DataFrame:
    """Counts per brand and sentiment, all of them, for display."""
    rows = combine(parts, "brand", "feedback_sentiment_category").select(
        "brand", "feedback_sentiment_category", F.col("n").alias("count")
    )
    return rows.orderBy(
        F.col("brand").asc_nulls_last(), F.col("count").desc(), F.col("feedback_sentiment_category").asc_nulls_last()
    )


def top_models(parts: DataFrame, n: int | None = TOP_COMPUTED) -> DataFrame:
    rows = combine(parts, "brand", "fridge_model").select(
        "brand",
        "fridge_model",
        F.col("n").alias("sales_count"),
        F.col("revenue").alias("total_revenue"),
        mean(F.col("revenue"), F.col("n")).alias("avg_price"),
    )
    return _top(rows, n, "sales_count", "brand", "fridge_model")


def totals(sales: DataFrame) -> DataFrame:
    """Row count, revenue and price statistics in one pass."""
    parts = partials(sales)
    return parts.select(
        F.col("n").alias("total_records"),
        F.coalesce(F.col("revenue"), F.lit(0).cast(MONEY_SUM)).alias("total_revenue"),
        zero_if_null(mean(F.col("revenue"), F.col("n"))).alias("mean_price"),
        zero_if_null(F.col("low")).alias("min_price"),
        zero_if_null(F.col("high")).alias("max_price"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_records"))


def price_stats(sales: DataFrame) -> DataFrame:
    return totals(sales).select("mean_price", "min_price", "max_price")


def total_revenue(sales: DataFrame) -> DataFrame:
    return sales.agg(F.coalesce(F.sum("price").cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM)).alias("total_revenue"))


def average_rating(sales: DataFrame) -> DataFrame:
    return sales.agg(
        mean(F.sum("feedback_rating"), F.count("feedback_rating")).alias("avg_rating"),
        F.count("feedback_rating").alias("n_ratings"),
    )


def sentiment_counts(sales: DataFrame) -> DataFrame:
    return sales.groupBy("feedback_sentiment_category").agg(F.count("*").alias("count"))


def count_where(sales: DataFrame, condition: Column) -> DataFrame:
    return sales.where(condition).agg(F.count("*").alias("count"))


def revenue_by_region(parts: DataFrame, n: int | None = 1) -> DataFrame:
    """Revenue per region named by the store address, biggest first."""
    rows = combine(parts, sales_region(F.col("store_address")).alias("region")).select(
        "region", F.col("revenue").alias("total_sales")
    )
    return _top(rows, n, "total_sales", "region")


def monthly_brand_sales(parts: DataFrame) -> DataFrame:
    """Sales per brand and month; partials must carry ``month``."""
    return combine(parts, "brand", "month").select(
        "brand", "month", F.col("n").alias("total_sales"), F.col("revenue").alias("total_revenue")
    )


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def previous_month(date: Column, as_of: Column) -> Column:
    """Is the date in the calendar month before ``as_of``?"""
    start = F.add_months(F.trunc(as_of, "month"), -1)
    return (date >= start) & (date < F.trunc(as_of, "month"))


def consistently_negative(parts: DataFrame, rate: float, months: int) -> DataFrame:
    """Stores whose share of negative feedback reached ``rate`` percent in ``months`` months or more."""
    monthly = combine(parts, "store_name", "month").withColumn(
        "rate", percentage(F.col("negative"), F.col("n"))
    )
    return (
        monthly.groupBy("store_name")
        .agg(
            F.count_if(F.col("rate") >= F.lit(rate).cast("decimal(5,2)")).alias("bad_months"),
            F.count("*").alias("active_months"),
        )
        .where(F.col("bad_months") >= months)
    )


def top_stores(parts: DataFrame, n: int = 3) -> DataFrame:
    rows = combine(parts, "store_name").select("store_name", F.col("revenue").alias("total_sales"))
    return _top(rows, n, "total_sales", "store_name")


def rating_between(low: int, high: int) -> Column:
    return F.col("feedback_rating").between(low, high)
