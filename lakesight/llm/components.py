"""Connected components of a graph of long keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesight.session import materialize


def _star(edges: DataFrame, name: str) -> DataFrame:
    """Join each (a, b) to the least neighbour of a; the minima are written so that a hub's rows can be split."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least")), name)
    return edges.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).drop("_a")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of an undirected graph but the least of its component, with that least node.

    ``edges`` has long columns a and b. Every round is written to the shared folder; only a
    count and a checksum come to the driver.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if mark == seen or not mark[0]:
            return edges
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(
            _star(both, "least").filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), "large")
        # Now every a has smaller neighbours only: they and a itself move to the least of them.
        met = _star(large, "least")
        edges = materialize(
            met.select("a", F.col("least").alias("b"))
            .unionByName(met.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
            .distinct(), "small")
