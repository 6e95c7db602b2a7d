"""Log lines as a stream, each shown once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.operators.logs import with_time


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they arrive."""
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def tail(lines: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """Stamped lines without repeats; a repeat arriving within the delay is dropped."""
    timed = with_time(lines).withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "ts"])
