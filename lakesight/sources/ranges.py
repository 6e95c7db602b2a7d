"""Tables written in key order, and a directory of their key ranges.

The directory has a row for each file: its smallest key and its number of rows, edits
included. With it a page of any depth is read from the one or two ranges it lies in, and rows
are looked up by key without reading the table: the ranges' borders reach the scan as filters,
where the statistics of sorted files leave out the rest.

A directory belongs to one version of the table and to the edits up to some number. When
further edits came, it is brought up to date from their keys alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.operators.keyed import PAGE_DEFAULT, PAGE_MAX, Page
from lakesight.operators.ordered import carry_last
from lakesight.session import materialize
from lakesight.sources.store import TableStore

#: A lookup names at most so many spans of keys to the scan; more are joined where the least lies between them.
MOST_SPANS = 200


def in_key_order(key: str) -> list[Column]:
    """Rising keys, NULLs last."""
    return [F.col(key).isNull(), F.col(key)]


def write_ranged(store: TableStore, name: str, rows: DataFrame, key: str = "id", ranges: int | None = None) -> DataFrame:
    """Publish a table whose files hold the keys range by range, each in order."""
    order = in_key_order(key)
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order)
    return store.write(name, dealt.sortWithinPartitions(*order))


def compact_ranged(store: TableStore, name: str, key: str = "id", ranges: int | None = None) -> DataFrame:
    """Fold the edits in and put the table in order again."""
    return write_ranged(store, name, store.current(name, key, store.last_edit(name)), key, ranges)


def state_name(version: int, edit: int) -> str:
    return f"v{version:08d}-e{edit:08d}"


def newest_state(store: TableStore, derived: str, version: int, edit: int) -> int | None:
    """The last edit that a table derived from this version contains, not beyond ``edit``."""
    found = (re.fullmatch(r"v(\d+)-e(\d+)", run) for run in store.runs(derived))
    edits = [int(m[2]) for m in found if m and int(m[1]) == version and int(m[2]) <= edit]
    return max(edits, default=None)


def _file_ranges(store: TableStore, name: str, key: str) -> DataFrame:
    """(_range, low, n) of the current version's files; files whose keys overlap form one range."""
    files = store.read(name).groupBy(F.col("_metadata.file_path").alias("_file")).agg(
        F.min(key).alias("low"), F.max(key).alias("_high"), F.count(F.lit(1)).alias("n"))
    # One row per file from here on.
    order = Window.orderBy(F.col("low").isNull(), "low", "_file")
    before = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = files.withColumn("_new", F.coalesce(F.col("low") > before, F.lit(True)).cast("int"))
    return (
        starts.withColumn("_range", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
        .groupBy("_range").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    )


def placed(keys: DataFrame, directory: DataFrame, key: str) -> DataFrame:
    """The range of each key: that of the last border not above it, the first one for keys below all."""
    place = lambda k, kind: F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("k"), F.lit(kind).alias("kind"))
    borders = directory.select(place("low", 0).alias("seq"), F.col("_range").alias("_border"))
    asked = keys.select(place(key, 1).alias("seq"), F.lit(None).cast("int").alias("_border"))
    found = carry_last(borders.unionByName(asked), "_border", "_range", [], "seq")
    return found.where("seq.kind = 1").select(F.col("seq.k").alias(key), F.coalesce("_range", F.lit(1)).alias("_range"))


def _spans(directory: DataFrame, ranges: DataFrame) -> list[tuple]:
    """(low, next low) of some ranges, neighbours joined; None stands for no border."""
    order = Window.orderBy("_range")
    borders = directory.withColumns({"_next": F.lead("low").over(order), "_first": F.row_number().over(order) == 1})
    rows = borders.join(ranges.select("_range").distinct(), "_range").orderBy("_range").select("_range", "low", "_next", "_first").collect()
    spans: list[list] = []
    for r in rows:
        low = None if r["_first"] else r["low"]
        if spans and spans[-1][3] == r["_range"] - 1:
            spans[-1][1:] = [r["_next"], r["_range"], r["_range"]]
        else:
            spans.append([low, r["_next"], r["_range"], r["_range"]])
    while len(spans) > MOST_SPANS:
        gaps = [b[2] - a[3] for a, b in zip(spans, spans[1:], strict=False)]
        at = gaps.index(min(gaps))
        spans[at : at + 2] = [[spans[at][0], spans[at + 1][1], spans[at][2], spans[at + 1][3]]]
    return [(low, high) for low, high, *_ in spans]


def within(key: str, spans: list[tuple]) -> Column:
    """A filter for keys in some spans, in a form that files can be left out by; NULL keys are in the last range."""
    parts = []
    for low, high in spans:
        inside = ([F.col(key) >= F.lit(low)] if low is not None else []) + ([F.col(key) < F.lit(high)] if high is not None else [])
        span = reduce(Column.__and__, inside) if inside else F.col(key).isNotNull()
        parts.append(span | F.col(key).isNull() if high is None else span)
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def lookup(store: TableStore, name: str, keys: DataFrame, spans: list[tuple], key: str = "id", upto: int | None = None) -> DataFrame:
    """The rows of some keys, as of an edit: only the spans of keys that hold them are read."""
    return store.current(name, key, upto).where(within(key, spans)).join(keys.select(key), key, "left_semi")


def borders(store: TableStore, name: str, key: str = "id") -> tuple[DataFrame, int]:
    """The newest directory of the current version and the edit it holds for; its borders hold for all edits."""
    kept, version = f"{name}_keys", store.version(name)
    known = newest_state(store, kept, version, store.last_edit(name))
    if known is None:
        known = store._current(name)[1]
        store.append(kept, _file_ranges(store, name, key).coalesce(1), state_name(version, known))
    return store.read_run(kept, state_name(version, known)), known


def changed_rows(store: TableStore, name: str, key: str, known: int, edit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the edits behind ``known`` up to ``edit`` changed: the rows their keys had, those they have, the keys' ranges."""
    ranges, _ = borders(store, name, key)
    changed = materialize(store.edited_keys(name, key, known, edit), "changed")
    moved = materialize(placed(changed, ranges, key), "placed")
    spans = _spans(ranges, moved)
    return lookup(store, name, changed, spans, key, known), lookup(store, name, changed, spans, key, edit), moved


def directory(store: TableStore, name: str, key: str = "id") -> DataFrame:
    """(_range, low, n) of a table written by :func:`write_ranged`, its edits counted in.

    Kept under the version and edit it holds for; what is there is only read. Later edits
    are counted by the keys that they added or took away.
    """
    kept, version, edit = f"{name}_keys", store.version(name), store.last_edit(name)
    rows, known = borders(store, name, key)
    if known < edit:
        before, after, moved = changed_rows(store, name, key, known, edit)
        weighed = before.select(key, F.lit(-1).alias("_d")).unionByName(after.select(key, F.lit(1).alias("_d")))
        net = weighed.groupBy(key).agg(F.sum("_d").alias("_d")).where("_d <> 0")
        per_range = net.join(moved, key).groupBy("_range").agg(F.sum("_d").alias("_d"))
        counted = rows.join(per_range, "_range", "left").select("_range", "low", (F.col("n") + F.coalesce("_d", F.lit(0))).alias("n"))
        store.append(kept, counted.coalesce(1), state_name(version, edit))
        rows = store.read_run(kept, state_name(version, edit))
    return rows


def stored_page(store: TableStore, name: str, key: str = "id", limit: int = PAGE_DEFAULT, offset: int = 0) -> Page:
    """One page in key order, NULLs last: at most 500 rows after ``offset``; and the total.

    The directory tells the ranges of the page; their keys alone are put in order to find
    its first and last one, which then go to the scan. Nothing is written once the directory
    is up to date. Rows that share a key come in no particular order.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    limit, offset = min(limit, PAGE_MAX), max(0, offset)
    upto = store.last_edit(name)
    rows = directory(store, name, key)
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("_end", F.sum("n").over(running)).withColumn("_start", F.col("_end") - F.col("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    touched = ends.where((F.col("_end") > offset) & (F.col("_start") < offset + limit) & (F.col("n") > 0))
    start = touched.agg(F.min("_start")).first()[0]
    table = store.current(name, key, upto)
    if start is None:
        return Page(table.limit(0), total)
    near = table.where(within(key, _spans(rows, touched)))
    order = in_key_order(key)
    # Ranges are files: what is numbered here is one or two of them.
    at = F.row_number().over(Window.orderBy(*order)) - 1 + start
    place = F.struct(order[0].alias("n"), F.col(key).alias("k"))
    numbered = near.select(key).withColumn("_at", at)
    first, last = numbered.where(F.col("_at").between(offset, offset + limit - 1)).agg(F.min(place), F.max(place)).first()
    bound = lambda p: F.struct(F.lit(p["n"]).alias("n"), F.lit(p["k"]).cast(table.schema[key].dataType).alias("k"))
    shared = numbered.where(place == bound(first)).agg(F.min("_at")).first()[0]
    sides = [F.col(key) >= F.lit(first["k"])] if not first["n"] else []
    sides += [F.col(key) <= F.lit(last["k"])] if not last["n"] else []
    inside = reduce(Column.__and__, sides) if sides else F.col(key).isNull()
    if last["n"]:
        inside = inside | F.col(key).isNull()
    return Page(near.where(inside).orderBy(*order).offset(offset - shared).limit(limit), total)
