"""Search over vectors stored as one signed byte per dimension, with an exact result.

A row's codes are its components divided by the row's own step and rounded; beside them
stands the distance between the vector and what its codes stand for. By the triangle
inequality that distance bounds, on both sides, how far the row is from any query. A search
scans the codes, a quarter of the bytes of single-precision vectors, and reads the vectors of
the rows that the bounds leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lakesight.operators.search import DECIMALS, apply_filters, filterable_columns, nearest
from lakesight.session import materialize
from lakesight.sources.store import TableStore

LEVELS = 127
#: Rows whose codes are widened at once.
KERNEL_ROWS = 1_024
#: Distances are rounded before they are compared.
SLACK = 10.0 ** (1 - DECIMALS)
PLACE = ["_block", "_place"]
BOUNDS = "_block int, _place long, _lower double, _upper double"


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, step and error of every row; what cannot be coded has an infinite error."""
    with np.errstate(all="ignore"):
        step = np.abs(vectors).max(axis=1, initial=0.0) / LEVELS
        codes = np.rint(vectors / np.where(step > 0, step, 1.0)[:, None])
        usable = np.isfinite(step) & np.isfinite(codes).all(axis=1)
        codes[~usable] = 0.0
        step[~usable] = 0.0
        left = vectors - codes * step[:, None]
        error = np.sqrt(np.einsum("ij,ij->i", left, left)) * (1.0 + 1e-9)
    error[~usable | ~np.isfinite(error)] = np.inf
    return np.clip(codes, -LEVELS, LEVELS).astype(np.int8), step, error


def bounds(codes: np.ndarray, step: np.ndarray, error: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance that each row can have from the query."""
    wide = codes.astype(np.float64)
    with np.errstate(all="ignore"):
        own = step * step * np.einsum("ij,ij->i", wide, wide)
        asked = query @ query
        square = own - 2.0 * step * (wide @ query) + asked
        # What sums of so many products can lose.
        loss = 4.0 * np.finfo(np.float64).eps * (len(query) + 8) * (own + asked)
        lower = np.sqrt(np.maximum(square - loss, 0.0)) - error
        upper = np.sqrt(np.maximum(square + loss, 0.0)) + error
    return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)


def _possible(query: Sequence[float], k: int):
    """Per task: the rows that can be among its ``k`` closest, judged by all rows before them."""
    asked = np.asarray(query, dtype=np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty(0)
        for batch in batches:
            for start in range(0, len(batch), KERNEL_ROWS):
                part = batch.iloc[start:start + KERNEL_ROWS]
                codes = np.frombuffer(b"".join(part["_codes"]), dtype=np.int8).reshape(len(part), len(asked))
                lower, upper = bounds(codes, part["_step"].to_numpy(), part["_error"].to_numpy(), asked)
                best = np.sort(np.concatenate([best, upper]))[:k]
                reach = best[-1] if len(best) == k else np.inf
                yield part[PLACE].assign(_lower=lower, _upper=upper)[lower - SLACK <= reach]

    return scan


@dataclass
class CodedVectors:
    """``codes`` hold place, filter columns and codes; ``rows`` the whole rows, in folders of one block each."""

    codes: DataFrame
    rows: DataFrame
    vector: str = "embedding"

    def candidates(self, query: Sequence[float], k: int, filters: Mapping[str, object] | None = None,
                   allowed: Sequence[str] | None = None) -> DataFrame:
        """Places of the rows that can be among the ``k`` closest of all."""
        names = filterable_columns(self.rows.schema) if allowed is None else allowed
        narrowed = apply_filters(self.codes, filters, names).where(F.octet_length("_codes") == len(query))
        seen = materialize(narrowed.select(*PLACE, "_codes", "_step", "_error").mapInPandas(_possible(query, k), BOUNDS), "bounds")
        # One number: the distance that the k-th closest row does not exceed.
        known = seen.select("_upper").orderBy("_upper").limit(k).agg(F.count(F.lit(1)), F.max("_upper")).first()
        reach = known[1] if known[0] == k else float("inf")
        return seen.where(F.col("_lower") - SLACK <= F.lit(reach)).select(*PLACE)

    def search(self, query: Sequence[float], k: int, filters: Mapping[str, object] | None = None,
               allowed: Sequence[str] | None = None, **options) -> DataFrame:
        """The ``k`` rows closest to the query vector, as ``nearest`` finds them.

        Rows whose vector is null, has null components or another length than the query are
        no results. Only blocks with candidates are read, whose number the plan is left to judge:
        of equal vectors there may be any number.
        """
        if not np.isfinite(np.asarray(query, dtype=np.float64)).all():
            raise ValueError("a query vector has finite components")
        found = self.candidates(query, k, filters, allowed)
        return nearest(self.rows.join(found, PLACE, "left_semi"), query, k, vector=self.vector, **options)


def _coder(vector: str):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Vectors of one length at a time; mostly there is one.
            for _, part in batch.groupby(batch[vector].map(len)):
                codes, step, error = encode(np.stack(part[vector].to_numpy()).astype(np.float64))
                yield part.drop(columns=vector).assign(_codes=[row.tobytes() for row in codes], _step=step, _error=error)

    return code


def load_codes(
    store: TableStore, name: str, rows: Callable[[], DataFrame], vector: str = "embedding", filters: Sequence[str] | None = None,
) -> CodedVectors:
    """Store the rows and their codes, unless the store holds both; the codes carry the columns of ``filters``.

    A row's place is given when the rows are written, and codes are made from what was written.
    """
    kept, coded = f"{name}_rows", f"{name}_codes"
    if store.is_empty(kept):
        given = rows()
        whole = given.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
        placed = whole.withColumns({"_block": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
        # A table of no folders would have no schema.
        store.write(kept, placed, partition_by=[] if whole.isEmpty() else ["_block"])
    stored = store.read(kept)
    if store.is_empty(coded):
        names = filterable_columns(stored.schema) if filters is None else list(filters)
        source = stored.select(*PLACE, *names, vector)
        schema = source.drop(vector).withColumns({"_codes": F.lit(b""), "_step": F.lit(0.0), "_error": F.lit(0.0)}).schema
        store.write(coded, source.mapInPandas(_coder(vector), schema))
    return CodedVectors(store.read(coded), stored, vector)
