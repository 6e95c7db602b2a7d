"""Row types of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

TEXT = T.StringType()
MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(28, 2)
VECTOR = T.ArrayType(T.FloatType(), False)

SALES_RAW = T.StructType([
    T.StructField("id", TEXT, False),
    T.StructField("customer_id", TEXT),
    T.StructField("brand", TEXT),
    T.StructField("fridge_model", TEXT),
    T.StructField("capacity_liters", T.DecimalType(10, 2)),
    T.StructField("price", MONEY),
    T.StructField("sales_date", T.DateType()),
    T.StructField("store_name", TEXT),
    T.StructField("store_address", TEXT),
    T.StructField("customer_feedback", TEXT),
    T.StructField("feedback_rating", T.IntegerType()),
    T.StructField("feedback_sentiment_category", TEXT),
])
SALES_COLUMNS = SALES_RAW.fieldNames()

SALES_EMBEDDINGS = T.StructType([*SALES_RAW.fields, T.StructField("embedding", VECTOR)])

BRAND_ROW = T.StructType([
    T.StructField("brand", TEXT),
    T.StructField("total_sales", T.LongType()),
    T.StructField("total_revenue", MONEY_SUM),
    T.StructField("avg_price", T.DoubleType()),
    T.StructField("min_price", MONEY),
    T.StructField("max_price", MONEY),
])
STORE_ROW = T.StructType([
    T.StructField("store_name", TEXT),
    T.StructField("total_sales", T.LongType()),
    T.StructField("total_revenue", MONEY_SUM),
    T.StructField("avg_sale_price", T.DoubleType()),
    T.StructField("negative_feedback_count", T.LongType()),
    T.StructField("positive_feedback_count", T.LongType()),
    T.StructField("negative_feedback_rate", T.DecimalType(5, 2)),
])
MODEL_ROW = T.StructType([
    T.StructField("brand", TEXT),
    T.StructField("fridge_model", TEXT),
    T.StructField("sales_count", T.LongType()),
    T.StructField("total_revenue", MONEY_SUM),
    T.StructField("avg_price", T.DoubleType()),
])
PRICE_STATS = T.StructType([
    T.StructField("mean_price", T.DoubleType()),
    T.StructField("min_price", T.DoubleType()),
    T.StructField("max_price", T.DoubleType()),
])

# The JSON columns of the snapshot table and the type each one parses to.
SNAPSHOT_JSON = {
    "sales_by_brand": T.ArrayType(BRAND_ROW),
    "store_performance": T.ArrayType(STORE_ROW),
    "top_models": T.ArrayType(MODEL_ROW),
    "price_stats": PRICE_STATS,
}
SNAPSHOT = T.StructType([
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("deploy_scope", TEXT),
    T.StructField("total_records", T.LongType()),
    T.StructField("total_revenue", MONEY_SUM),
    *[T.StructField(name, TEXT) for name in SNAPSHOT_JSON],
])

TRACE = T.StructType([
    T.StructField("query_id", TEXT, False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", TEXT),
    T.StructField("iteration", T.IntegerType()),
    T.StructField("tool", TEXT),
    T.StructField("success", T.BooleanType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("sql", TEXT),
    T.StructField("error", TEXT),
    T.StructField("execution_time_ms", T.DoubleType()),
    T.StructField("input", TEXT),
    T.StructField("question", TEXT),
    T.StructField("answer", TEXT),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])

PHASES = T.StructType([
    T.StructField("scope", TEXT),
    T.StructField("component", TEXT),
    T.StructField("identifier", TEXT),
    T.StructField("duration_sec", T.DoubleType()),
])

RESOURCES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("resource_type", TEXT),
    T.StructField("name", TEXT),
    T.StructField("region", TEXT),
    T.StructField("display", TEXT),
    T.StructField("lb_type", TEXT),
    T.StructField("tags", T.MapType(TEXT, TEXT)),
])

LOG_LINES = T.StructType([
    T.StructField("line_no", T.LongType()),
    T.StructField("line", TEXT),
])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in required if name not in present]


def vector_column_ok(df: DataFrame, column: str = "embedding") -> bool:
    """Is there an array column of that name holding floating-point numbers?"""
    if column not in df.columns:
        return False
    kind = df.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
