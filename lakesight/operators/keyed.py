"""Keyed maintenance of tables: upsert, edit, delete, lookup and paging.

Parquet tables cannot be merged in place, so every operator returns the new
content of the table, to be published as its next version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.functions.cleaning import EDIT_DEFAULTS
from lakesight.schema import SALES_RAW
from lakesight.session import materialize

PAGE_DEFAULT = 100
PAGE_MAX = 500
#: Pages that end within so many rows come from the smallest keys that each task keeps.
SHALLOW = 10_000


class Edited(NamedTuple):
    table: DataFrame
    not_found: DataFrame


class Deleted(NamedTuple):
    raw: DataFrame
    embeddings: DataFrame
    not_found: DataFrame


def last_write_wins(rows: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in ``order``.

    The rank filter is pushed below the shuffle, so each task sends on one row per
    key and a key with very many rows is thinned out where it is read.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order])
    return rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Insert new keys and replace the whole row of known ones.

    ``source`` must hold each key once; see :func:`last_write_wins`.
    """
    kept = target.join(source.select(key), key, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def full_rows(edits: DataFrame, key: str = "id") -> DataFrame:
    """Complete rows out of edits: an absent field takes its default, not the old value."""
    columns = []
    for field in SALES_RAW.fields:
        if field.name == key:
            value = F.col(key)
        elif field.name in edits.columns:
            value = F.col(field.name)
        else:
            value = F.lit(EDIT_DEFAULTS[field.name])
        if field.name == "price":
            value = F.coalesce(value, F.lit(0))
        columns.append(value.cast(field.dataType).alias(field.name))
    return edits.select(*columns)


def replace_rows(target: DataFrame, edits: DataFrame, key: str = "id") -> Edited:
    """Full-row edits of known keys; edits of unknown keys are reported, not inserted."""
    known = target.select(key)
    found = edits.join(known, key, "left_semi")
    missing = edits.join(known, key, "left_anti").select(key)
    return Edited(upsert(target, found.select(*target.columns), key), missing)


def delete_rows(raw: DataFrame, embeddings: DataFrame, ids: DataFrame, key: str = "id") -> Deleted:
    """Delete keys from both tables; a key the raw table lacks is deleted from neither."""
    asked = ids.select(key).distinct()
    found = asked.join(raw.select(key), key, "left_semi")
    return Deleted(
        raw.join(found, key, "left_anti"),
        embeddings.join(found, key, "left_anti"),
        asked.join(raw.select(key), key, "left_anti"),
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``after`` whose key is new, or whose content differs from the row of that key in ``before``.

    Keys are unique. Rows meet by key, and of the old ones only a digest travels.
    """
    content = [c for c in after.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    old = before.select(F.col(key).alias("_key"), digest.alias("_old"))
    same = (F.col(key) == F.col("_key")) & (digest == F.col("_old"))
    return after.join(old, same, "left_anti")


def refresh_vectors(
    embeddings: DataFrame, touched: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "id"
) -> DataFrame:
    """Recompute the vectors of the touched rows only and upsert them."""
    return upsert(embeddings, embed(touched), key)


def pair_vectors(rows: DataFrame, vectors: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Each row with its vector."""
    return rows.join(vectors, rows[left_key] == vectors[right_key])


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


class Page(NamedTuple):
    rows: DataFrame
    total: int


def _in_order(df: DataFrame, key: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The keys dealt by ranges in key order, NULLs last, and the row count of each range."""
    order = [F.col(key).isNull(), F.col(key)]
    dealt = materialize(df.select(key).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    return dealt, sorted(tuple(r) for r in dealt.groupBy("_range").count().collect())


def page(df: DataFrame, key: str = "id", limit: int = PAGE_DEFAULT, offset: int = 0) -> Page:
    """One page in key order, NULLs last: at most 500 rows after ``offset``; and the total.

    Near the front each task keeps the first rows. Deeper down the keys alone are dealt by ranges and counted; only the ranges that the page touches
    are put in order, and at most 500 keys, or their ends, go back to the table. The driver
    sees one number per range. Rows that share a key come in no particular order.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    limit, offset = min(limit, PAGE_MAX), max(0, offset)
    if offset + limit <= SHALLOW:
        return Page(df.orderBy(F.col(key).isNull(), F.col(key)).offset(offset).limit(limit), df.select(key).count())
    dealt, sizes = _in_order(df, key)
    total, before, touched = sum(n for _, n in sizes), 0, []
    for number, n in sizes:
        if before + n > offset and before < offset + limit:
            touched.append((number, before))
        before += n
    if not touched:
        return Page(df.limit(0), total)
    order = [F.col(key).isNull(), F.col(key)]
    start = F.create_map(*[F.lit(x) for pair in touched for x in pair])[F.col("_range")]
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = dealt.where(F.col("_range").isin([n for n, _ in touched])).withColumn("_at", nth + start)
    place = F.struct(order[0].alias("n"), F.col(key).alias("k"))
    first, last = numbered.where(F.col("_at").between(offset, offset + limit - 1)).agg(F.min(place), F.max(place)).first()
    bound = lambda at: F.struct(F.lit(at["n"]).alias("n"), F.lit(at["k"]).cast(df.schema[key].dataType).alias("k"))
    # Rows that share the first key may belong to the page before.
    shared = numbered.where(place == bound(first)).agg(F.min("_at")).first()[0]
    within = df.where((place >= bound(first)) & (place <= bound(last)))
    return Page(within.orderBy(*order).offset(offset - shared).limit(limit), total)


def page_after(df: DataFrame, key: str, last: object, limit: int = PAGE_DEFAULT) -> DataFrame:
    """The page that follows a key; its cost does not grow with the depth."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(min(limit, PAGE_MAX))
