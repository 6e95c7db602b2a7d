"""The driver's Parquet tables and the retail model on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

def price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


# A city for each region key, so that addresses name a place.
CITIES = {0: "New York, NY", 1: "Chicago, IL", 2: "Los Angeles, CA", 3: "Houston, TX"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sentiment() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "R", "Negative").when(flag == "A", "Positive").otherwise("Neutral")


def rating() -> Column:
    return (F.col("l_quantity").cast("int") % 10 + 1).cast("int")


def sale_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))


def brands(spark: SparkSession, folder: str) -> DataFrame:
    """Part key → brand and model."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("brand"),
        F.concat_ws(" ", "p_type", "p_name").alias("fridge_model"),
        F.col("p_size").cast("decimal(10,2)").alias("capacity_liters"),
    )


def stores(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier key → store name and address."""
    city = None
    for key, place in CITIES.items():
        hit = F.col("n_regionkey") == key
        city = F.when(hit, place) if city is None else city.when(hit, place)
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"),
        F.concat_ws(", ", "n_name", city.otherwise("Elsewhere")).alias("store_address"),
    )
    return table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("store_name"), "store_address"
    )


def buyers(spark: SparkSession, folder: str) -> DataFrame:
    """Order key → customer id."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("customer_id")
    )


def sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The denormalised sales table, joined only as far as ``columns`` need.

    No join is hinted: Catalyst broadcasts a dimension whose measured size is
    under its threshold and shuffles otherwise, and the adaptive skew join splits
    a key that holds a large share of the rows.
    """
    wanted = set(columns) or {
        "id", "customer_id", "brand", "fridge_model", "capacity_liters", "price", "sales_date", "store_name",
        "store_address", "customer_feedback", "feedback_rating", "feedback_sentiment_category",
    }
    facts = table(spark, folder, "lineitem")
    if wanted & {"brand", "fridge_model", "capacity_liters"}:
        facts = facts.join(brands(spark, folder), "l_partkey")
    if wanted & {"store_name", "store_address"}:
        facts = facts.join(stores(spark, folder), "l_suppkey")
    if "customer_id" in wanted:
        facts = facts.join(buyers(spark, folder), "l_orderkey")
    derived = {
        "id": sale_id(),
        "price": price(),
        "sales_date": F.col("l_shipdate").cast("date"),
        "feedback_rating": rating(),
        "feedback_sentiment_category": sentiment(),
        "customer_feedback": F.concat_ws(" ", sentiment(), F.lit("feedback on order"), F.col("l_orderkey")),
    }
    order = list(columns) or [
        "id", "customer_id", "brand", "fridge_model", "capacity_liters", "price", "sales_date", "store_name",
        "store_address", "customer_feedback", "feedback_rating", "feedback_sentiment_category",
    ]
    return facts.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in order])


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback texts with their vectors: the searchable corpus."""
    documents = table(spark, folder, "documents")
    vectors = table(spark, folder, "embeddings")
    return documents.join(vectors, documents.doc_id == vectors.vec_id).select(
        "doc_id", "text", "lang", "source", "n_chars", "embedding", "label"
    )
