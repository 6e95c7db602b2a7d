"""The batch run: sales copy, section rollups, one snapshot row, and its serving view."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions import cleaning, formats
from lakesight.operators import rollups as R
from lakesight.schema import (
    BRAND_ROW, MODEL_ROW, MONEY_SUM, SNAPSHOT, SNAPSHOT_JSON, STORE_ROW,
)
from lakesight.sources.store import TableStore, require_rows, snapshot_sales

TOP_SERVED = 8

SNAPSHOTS = "batch_analytics"
FEEDBACK = "batch_feedback"
TRIMMED = ["sales_by_brand", "store_performance", "top_models"]


class Parts(NamedTuple):
    """Partials of a batch run: per brand, model and sentiment, and per store."""

    models: DataFrame
    stores: DataFrame


def section_parts(sales: DataFrame) -> Parts:
    """Two folds over narrow columns; every section but the stores derives from the first."""
    tone = "feedback_sentiment_category"
    return Parts(
        R.partials(sales.select("brand", "fridge_model", tone, "price"), "brand", "fridge_model", tone),
        R.partials(sales.select("store_name", tone, "price"), "store_name"),
    )


def _array(rows: DataFrame, order: list[Column], schema) -> DataFrame:
    """One row holding the rows as a sorted array; only for row counts known to be small."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    ranked = rows.select(F.struct(*order, F.struct(*fields).alias("row")).alias("item"))
    return ranked.agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        F.transform("items", lambda i: i["row"]).alias("items")
    )


def feedback_rows(parts: Parts) -> DataFrame:
    """Counts per brand and sentiment, one row each."""
    return R.combine(parts.models, "brand", "feedback_sentiment_category").select(
        "brand", "feedback_sentiment_category", F.col("n").alias("count")
    )


def assemble(parts: Parts, created_at: datetime, scope: str | None, n: int = R.TOP_COMPUTED) -> DataFrame:
    """The snapshot row, its nested sections as JSON text.

    The top-N arrays hold at most ``n`` rows. Feedback has no limit and so no cell: it
    stays rows of its own table, under the same run.
    """
    brand = R.sales_by_brand(parts.models, n)
    store = R.store_performance(parts.stores, n)
    model = R.top_models(parts.models, n)
    total = R.combine(parts.models)

    sections = {
        "sales_by_brand": _array(brand, [(-F.col("total_sales")).alias("k1"), F.col("brand").alias("k2")], BRAND_ROW),
        "store_performance": _array(
            store, [(-F.col("total_revenue")).alias("k1"), F.col("store_name").alias("k2")], STORE_ROW
        ),
        "top_models": _array(
            model,
            [(-F.col("sales_count")).alias("k1"), F.col("brand").alias("k2"), F.col("fridge_model").alias("k3")],
            MODEL_ROW,
        ),
    }
    pieces = [
        total.select(
            F.coalesce("n", F.lit(0).cast("long")).alias("total_records"),
            F.coalesce("revenue", F.lit(0).cast(MONEY_SUM)).alias("total_revenue"),
            F.to_json(
                F.struct(
                    formats.zero_if_null(formats.mean(F.col("revenue"), F.col("n"))).alias("mean_price"),
                    formats.zero_if_null(F.col("low")).alias("min_price"),
                    formats.zero_if_null(F.col("high")).alias("max_price"),
                )
            ).alias("price_stats"),
        )
    ]
    pieces += [rows.select(F.to_json("items").alias(name)) for name, rows in sections.items()]
    union = pieces[0]
    for piece in pieces[1:]:
        union = union.unionByName(piece, allowMissingColumns=True)
    present = set(union.columns)
    row = union.agg(
        *[
            (F.max(f.name) if f.name in present else F.max(F.lit(None).cast(f.dataType))).alias(f.name)
            for f in SNAPSHOT.fields[2:]
        ]
    )
    return row.select(
        F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(scope or None).cast("string").alias("deploy_scope"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields[2:]],
    )


def append_snapshot(store: TableStore, snapshot: DataFrame, run: str) -> None:
    """Add one run, or replace it when it is repeated; a failed write raises."""
    store.append(SNAPSHOTS, snapshot.coalesce(1), run)


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest run, whichever scheduler wrote it; of runs at the same time, the last by name."""
    return snapshots.orderBy(F.col("created_at").desc_nulls_last(), F.col("run").desc_nulls_last()).limit(1)


def latest_feedback(store: TableStore, snapshots: DataFrame) -> DataFrame:
    """The feedback rows of the newest run; its name reaches the scan as a folder filter."""
    newest = latest(snapshots).select("run").first()
    rows = store.read_appended(FEEDBACK)
    return rows.where(F.col("run") == newest["run"]) if newest else rows.limit(0)


def saved_total(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.max_by("total_records", F.struct("created_at", "run")).alias("saved_total"))


def verify_saved_total(snapshots: DataFrame, expected: int) -> None:
    """Raise unless the newest run holds the expected number of records."""
    saved = saved_total(snapshots).first()["saved_total"]
    if saved is None:
        raise RuntimeError("no snapshot found after the write")
    if saved != expected:
        raise RuntimeError(f"self-check failed: saved total_records={saved}, expected={expected}")


def run_batch(
    store: TableStore,
    raw: DataFrame,
    created_at: datetime,
    scope: str | None = None,
    n: int = R.TOP_COMPUTED,
    source: DataFrame | None = None,
    run: str | None = None,
    copy: bool = True,
    parts: Parts | None = None,
) -> DataFrame:
    """One batch run: copy, roll up, append the snapshot, check it. Returns all snapshots.

    ``run`` names the run, by default after its time; a run that is repeated replaces its
    rows. Without ``copy`` the sales are rolled up where they are, for callers that keep
    them in the store themselves; with ``parts``, partials that are kept up to date, they
    are not rolled up at all.
    """
    clean = cleaning.batch_defaults(cleaning.add_missing_columns(raw))
    sales = snapshot_sales(store, clean, source=source) if copy else require_rows(clean)
    run = run or f"at-{created_at:%Y%m%dT%H%M%S%f}"
    # Groups only; a lost block is computed again.
    parts = Parts(*[p.persist() for p in parts or section_parts(sales)])
    try:
        store.append(FEEDBACK, feedback_rows(parts).withColumn("created_at", F.lit(created_at).cast("timestamp")), run)
        append_snapshot(store, assemble(parts, created_at, scope, n), run)
        # The store partials count every row once more, independently of the saved total.
        expected = parts.stores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        for p in parts:
            p.unpersist()
    snapshots = store.read_appended(SNAPSHOTS)
    verify_saved_total(snapshots.where(F.col("run") == run), expected)
    return snapshots


def parsed(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows with their JSON columns as typed arrays and structs."""
    return snapshots.withColumns({name: F.from_json(name, kind) for name, kind in SNAPSHOT_JSON.items()})


def serve(snapshots: DataFrame, interval_seconds: int, n: int = TOP_SERVED) -> DataFrame:
    """The newest run as shown to readers: arrays cut to ``n``, defaults for missing totals."""
    row = parsed(latest(snapshots))
    return row.withColumns(
        {
            **{name: F.slice(name, 1, n) for name in TRIMMED},
            "total_records": F.coalesce("total_records", F.lit(0).cast("long")),
            "total_revenue": F.coalesce("total_revenue", F.lit(0).cast(MONEY_SUM)),
            "last_updated_at": formats.iso_utc(formats.utc_wall(F.col("created_at"))),
            "analytics_run_interval_minutes": formats.interval_minutes(F.lit(interval_seconds)),
            "updated_by_scope": F.nullif(F.col("deploy_scope"), F.lit("")),
        }
    )


def summary(snapshots: DataFrame) -> DataFrame:
    """The one-row summary kept beside the snapshots."""
    row = parsed(latest(snapshots))
    return row.select(
        "total_records",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("price_stats.mean_price").alias("avg_price"),
        formats.iso_utc(formats.utc_wall(F.col("created_at"))).alias("last_updated"),
    )


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """One row per layer with its row count."""
    union = None
    for name, rows in layers.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        union = counted if union is None else union.unionByName(counted)
    return union


def count_check(counts: DataFrame, expected: str) -> DataFrame:
    """Every layer's count against that of the ``expected`` layer.

    The list holds one entry per layer the caller named, never rows of a table.
    """
    folded = counts.agg(
        F.max(F.when(F.col("layer") == expected, F.col("n"))).alias("expected"),
        F.collect_list(F.struct("layer", "n")).alias("layers"),
    )
    return folded.select("expected", F.inline("layers")).select(
        "layer", "n", "expected", F.col("n").eqNullSafe(F.col("expected")).alias("ok")
    )


def report_rows(checks: DataFrame, provider: str, scope: str) -> DataFrame:
    """Quality report: one row per check with a note on what was compared."""
    return checks.select(
        F.lit(provider).alias("provider"),
        F.lit(scope).alias("scope"),
        F.col("layer").alias("endpoint"),
        "ok",
        F.concat(F.lit("count="), F.col("n"), F.lit(" expected="), F.col("expected")).alias("notes"),
    )
