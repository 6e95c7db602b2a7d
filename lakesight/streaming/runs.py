"""Running streams to the end of what is there, with results kept in shared storage."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesight.operators.keyed import last_write_wins
from lakesight.plans.refresh import refreshed_parts
from lakesight.plans.snapshot import run_batch
from lakesight.sources import ranges
from lakesight.sources.store import TableStore


def run_appended(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into Parquet files (append mode)."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updated(stream: DataFrame, path: str, checkpoint: str, key: str | list[str]) -> DataFrame:
    """Process everything available in update mode; returns the last row of every key.

    Each micro-batch replaces its own folder, so a batch that is repeated after a
    failure leaves the same files.
    """

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    saved = stream.sparkSession.read.option("basePath", path).parquet(path)
    return last_write_wins(saved, key, ["batch"]).drop("batch")


def start_refresh(
    raw: DataFrame,
    store: TableStore,
    checkpoint: str,
    order: list[str],
    scope: str | None = None,
    interval: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    key: str = "id",
) -> StreamingQuery:
    """Keep the snapshot fresh: record arriving rows as edits, then run the batch job.

    Only the changed rows are written, and the rollups take in only what they changed: see
    ``plans.refresh``. ``ranges.compact_ranged`` folds the edits in on a schedule.

    Without ``interval`` what is there is processed once; with it the job repeats.
    Runs never overlap, since a stream handles one micro-batch at a time. A batch
    repeated after a failure finds itself in the log and is skipped.
    """

    def refresh(rows: DataFrame, batch_id: int) -> None:
        log = "refresh_log"
        done = store.exists(log) and not store.read(log).where(F.col("batch_id") >= batch_id).isEmpty()
        if done:
            return
        arrived = last_write_wins(prepare(rows) if prepare else rows, key, order)
        # A batch repeated after a failure puts the same rows and the same run again.
        if store.exists("sales_raw"):
            store.edit("sales_raw", arrived)
        else:
            ranges.write_ranged(store, "sales_raw", arrived, key)
        run_batch(
            store, store.current("sales_raw", key), clock(), scope, run=f"refresh-{batch_id:08d}", copy=False,
            parts=refreshed_parts(store, "sales_raw", key))
        store.write(log, rows.sparkSession.createDataFrame([(batch_id,)], "batch_id long"))

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        raw.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
