"""The load lane: raw files → raw table → vectors, and edits of the loaded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakesight.functions.cleaning import embed_defaults
from lakesight.operators import keyed
from lakesight.operators.embed import Embed, embed_column
from lakesight.schema import SALES_COLUMNS
from lakesight.sources import csv_files
from lakesight.sources.store import TableStore, load_once, require_vectors

RAW, VECTORS = "sales_raw", "sales_embeddings"


def load_raw(
    store: TableStore, path: str | list[str], force: bool = False, multi_line: bool = True, strict: bool = False,
) -> tuple[DataFrame, bool]:
    """Sales files into the raw table, the last row of each id; skipped when it holds rows.

    A ``strict`` load fails, and leaves the table as it was, if any value is of the wrong type.
    """

    def rows() -> DataFrame:
        raw = csv_files.read_raw_csv(store.spark, path, multi_line)
        typed = csv_files.clean_raw(raw)
        return csv_files.last_in_file(csv_files.require_good(raw, typed) if strict else typed)

    return load_once(store, RAW, rows, force)


def embedded(rows: DataFrame, embed: Embed) -> DataFrame:
    """Sales rows as the search needs them: four fields filled, the feedback text as a vector."""
    return embed_column(embed_defaults(rows.select(*SALES_COLUMNS)), "customer_feedback", embed)


def load_vectors(store: TableStore, embed: Embed, dimension: int | None = None, force: bool = False) -> tuple[DataFrame, bool]:
    """The raw table into the vector table; skipped when that holds rows."""

    def rows() -> DataFrame:
        raw = store.read(RAW)
        if raw.isEmpty():
            raise RuntimeError("the raw table holds no rows")
        return embedded(raw, embed)

    # The check comes before the rows become the table, so a bad load leaves nothing to skip.
    check = None if dimension is None else lambda saved: require_vectors(saved, dimension)
    return load_once(store, VECTORS, rows, force, check)


def announce(raw: DataFrame, vectors: DataFrame) -> DataFrame:
    """The two counts as a log line."""
    counts = raw.agg(F.count("*").alias("n")).withColumn("label", F.lit("RAW")).unionByName(
        vectors.agg(F.count("*").alias("n")).withColumn("label", F.lit("EMBEDDINGS"))
    )
    return counts.select(F.concat("label", F.lit("_COUNT="), "n").alias("line"))


def save_rows(store: TableStore, rows: DataFrame, embed: Embed) -> None:
    """Insert or replace whole rows, vectors included: only these rows are embedded."""
    full = keyed.full_rows(rows)
    store.edit_all({RAW: full, VECTORS: embedded(full, embed)})


def update_rows(store: TableStore, edits: DataFrame, embed: Embed) -> DataFrame:
    """Replace known rows; returns the keys that were not found."""
    known = store.current(RAW).select("id")
    save_rows(store, edits.join(known, "id", "left_semi"), embed)
    return edits.join(known, "id", "left_anti").select("id")


def delete_ids(store: TableStore, ids: DataFrame) -> DataFrame:
    """Delete from both tables what the raw table holds; returns the keys it does not."""
    asked, known = ids.select("id").distinct(), store.current(RAW).select("id")
    found, missing = asked.join(known, "id", "left_semi"), asked.join(known, "id", "left_anti")
    # The answer is fixed before the table changes under it.
    missing = store.write("_not_found", missing)
    found = store.write("_deleted", found)
    store.edit_all({RAW: found, VECTORS: found}, delete=True)
    return missing
