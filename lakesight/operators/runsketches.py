"""Distinct counts and quantiles over several runs without their rows.

Each run of a load leaves sketches of its groups: one for distinct values, one for quantiles.
They are merged when asked, over any choice of runs, so that the rows of earlier runs are not
read again. Counts are exact, distinct counts and quantiles have the error of the sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.sources.store import TableStore

#: Size of a distinct sketch as a power of two, and the accuracy parameter of a quantile sketch.
DISTINCT_BITS, QUANTILE_K = 12, 200
#: Three standard errors of a distinct count, and the rank error of a quantile that 99 of 100 stay within.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2), 0.0133


def sketches(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, n_values, distinct, values): one row per group; tasks sketch their rows before the shuffle.

    Nulls are counted as rows, not as values.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"),
        F.hll_sketch_agg(distinct, F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("values"),
    )


def add_run(store: TableStore, name: str, rows: DataFrame, run: str, keys: Sequence[str], distinct: str, value: str) -> None:
    """Keep the sketches of one run; a repeated run replaces its own."""
    store.append(name, sketches(rows, keys, distinct, value), run)


def merged(store: TableStore, name: str, keys: Sequence[str], runs: Column | None = None) -> DataFrame:
    """The sketches of all runs, or those a condition on ``run`` leaves, one row per group."""
    kept = store.read_appended(name)
    kept = kept if runs is None else kept.where(runs)
    return kept.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("values").alias("values"),
    )


def estimated(parts: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, distinct, quantiles): what the sketches say; a quantile of no values is NULL."""
    said = [
        F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(name) for name, q in quantiles.items()]
    return parts.select(*keys, "n", F.hll_sketch_estimate("distinct").alias("distinct"), *said)
