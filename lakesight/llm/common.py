"""Small helpers that several pipeline operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakesight.session import materialize

# Fixed value: the blanks of the contracts, space and U+0009 to U+000D, as a character class body.
BLANK = " \\t-\\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole(text: Column | str) -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Leave out columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number rows 0, 1, … in one order over the whole table.

    Range partitions are numbered apart and shifted by the rows before them; only one
    count per partition passes through a single task.
    """
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        parts.withColumn("_within", within).join(starts, "_part")
        .withColumn(rank, F.col("_within") + F.col("_start")).drop("_within", "_start", "_part")
    )


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Send texts to Python in Arrow batches of few rows and few bytes, so that a batch of long texts fits a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
