"""Rollup partials that are kept up to date from changed rows.

A partial holds what its group's rows add up to, so a changed row is taken in by adding the
new row and taking the old one out again. Counts and sums can be taken back as they are.
Extremes cannot: of each group the smallest and largest values are therefore kept with their
counts, up to ``EXTREMES`` of them at either end. A value that is taken out gives way to the
next one in the list; only when a list runs empty is its group folded again from its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.schema import MONEY_SUM
from lakesight.session import materialize

#: Values kept at either end of a group.
EXTREMES = 16
SUMS = ["n", "priced", "total", "negative", "positive"]
LISTS = ["lows", "lows_whole", "highs", "highs_whole"]
WEIGHT = "_weight"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that left with the weight -1 and rows that came with +1."""
    return before.withColumn(WEIGHT, F.lit(-1)).unionByName(after.withColumn(WEIGHT, F.lit(1)))


def _column(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, where null equals null; the right side's keys end in an underscore."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"{k}_"]) for k in keys])


def _other(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"{k}_" for k in keys})


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    weight, tone = F.col(WEIGHT), _column(rows, "feedback_sentiment_category")
    price = _column(rows, "price").cast("decimal(18,2)")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(
        F.sum(weight).cast("long").alias("n"), count(price.isNotNull()).alias("priced"),
        F.coalesce(F.sum(price * weight), F.lit(0)).cast(MONEY_SUM).alias("total"),
        count(tone == "Negative").alias("negative"), count(tone == "Positive").alias("positive"),
    )


def _values(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each price of a group came (or, below zero, left)."""
    priced = rows.withColumn("v", _column(rows, "price").cast("decimal(18,2)")).where("v IS NOT NULL")
    return priced.groupBy(*keys, "v").agg(F.sum(WEIGHT).cast("long").alias("c")).where("c <> 0")


def _ends(values: DataFrame, keys: Sequence[str], rising: bool, name: str) -> DataFrame:
    """The first values of each group with their counts, and whether these are all.

    The rank limit is applied before the shuffle, so a group has a bounded list whatever its size.
    """
    order = F.col("v").asc() if rising else F.col("v").desc()
    ranked = values.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_at") <= EXTREMES + 1)
    kept = F.sort_array(F.collect_list(F.when(F.col("_at") <= EXTREMES, F.struct("_at", "v", "c"))))
    return ranked.groupBy(*keys).agg(
        F.transform(kept, lambda x: F.struct(x["v"].alias("v"), x["c"].alias("c"))).alias(name),
        (F.max("_at") <= EXTREMES).alias(f"{name}_whole"),
    )


def _with_lists(sums: DataFrame, lists: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    for rows in lists:
        other = _other(rows, keys)
        sums = sums.join(other, _same(sums, other, keys), "left").drop(*[f"{k}_" for k in keys])
    empty = F.array().cast("array<struct<v:decimal(18,2),c:bigint>>")
    return sums.select(
        *keys, *SUMS, *[F.coalesce(c, F.lit(True) if c.endswith("_whole") else empty).alias(c) for c in LISTS])


def build(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The partials of a whole table: sums, and the values at either end of each group."""
    weighed = rows.withColumn(WEIGHT, F.lit(1))
    values = _values(weighed, keys)
    return _with_lists(_sums(weighed, keys), [_ends(values, keys, True, "lows"), _ends(values, keys, False, "highs")], keys)


def _moved(touched: DataFrame, values: DataFrame, keys: Sequence[str], rising: bool, name: str) -> DataFrame:
    """The lists of touched groups after values came and left.

    A list that does not hold all values says nothing about those beyond its last one:
    what comes or leaves there is not its business.
    """
    last = F.element_at(name, -1)["v"]
    inside = (F.col("v") <= F.col("_last")) if rising else (F.col("v") >= F.col("_last"))
    bounds = _other(touched.select(*keys, F.col(f"{name}_whole").alias("_whole"), F.when(F.size(name) > 0, last).alias("_last")), keys)
    arrived = values.join(bounds, _same(values, bounds, keys)).where(F.col("_whole") | F.coalesce(inside, F.lit(False))).select(*keys, "v", "c")
    known = touched.select(*keys, F.explode(name).alias("x")).select(*keys, "x.v", "x.c")
    left = known.unionByName(arrived).groupBy(*keys, "v").agg(F.sum("c").alias("c")).where("c > 0")
    rows = _ends(left, keys, rising, name)
    whole = _other(touched.select(*keys, F.col(f"{name}_whole").alias("_whole")), keys)
    return rows.join(whole, _same(rows, whole, keys)).select(
        *keys, name, (F.col(f"{name}_whole") & F.col("_whole")).alias(f"{name}_whole"))


def apply_changes(
    parts: DataFrame, changed: DataFrame, keys: Sequence[str], rows_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Partials after ``changed`` rows came and left; groups without rows go.

    ``parts`` comes from :func:`build` or from here. ``rows_of`` returns the present rows of
    the groups it is given; it is asked only for groups whose list of extremes ran empty.
    Untouched groups pass unchanged, and no row of theirs is read.
    """
    delta, values = _sums(changed, keys), _values(changed, keys)
    lists = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in LISTS]
    both = parts.withColumn("_touched", F.lit(False)).unionByName(delta.select(*keys, *SUMS, *lists, F.lit(True).alias("_touched")))
    met = materialize(
        both.groupBy(*keys).agg(
            *[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS],
            *[F.first(c, ignorenulls=True).alias(c) for c in LISTS], F.max("_touched").alias("_touched"),
        ), "parts")
    touched = met.where("_touched AND n > 0")
    # A group that is new has no lists yet: they are empty and hold all it has.
    touched = touched.withColumns({
        c: F.coalesce(c, F.lit(True) if c.endswith("_whole") else F.array().cast(parts.schema[c].dataType)) for c in LISTS})
    moved = materialize(_with_lists(
        touched.select(*keys, *SUMS),
        [_moved(touched, values, keys, True, "lows"), _moved(touched, values, keys, False, "highs")], keys), "moved")
    exhausted = (F.col("priced") > 0) & ((F.size("lows") == 0) | (F.size("highs") == 0))
    kept = met.where("NOT _touched").select(*parts.columns).unionByName(moved.where(~exhausted).select(*parts.columns))
    lost = moved.where(exhausted).select(*keys)
    if lost.isEmpty():
        return kept
    return kept.unionByName(build(rows_of(lost), keys).select(*parts.columns))


def rows_in(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of some groups."""
    other = _other(groups.select(*keys), keys)
    return rows.join(other, _same(rows, other, keys), "left_semi")


def as_partials(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """In the form that the rollups take: count, revenue, extremes and sentiment counts."""
    return parts.select(
        *keys, "n", F.when(F.col("priced") > 0, F.col("total")).alias("revenue"),
        F.get("lows", F.lit(0))["v"].alias("low"), F.get("highs", F.lit(0))["v"].alias("high"), "negative", "positive",
    )
