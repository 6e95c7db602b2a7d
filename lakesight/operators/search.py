"""Exact nearest-neighbour search by Euclidean distance, with IN filters.

Distances are rounded to nine decimals, so that the order of equals is decided by
the key and not by the order of a floating-point sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lakesight.functions.vectors import l2_distance, vector_literal
from lakesight.session import materialize

TOP_K = 50
FALLBACK_K = 30
# Rows of the corpus that a task holds in memory.
CORPUS_CHUNK = 50_000
DECIMALS = 9

# The columns a search returns.
RESULT_COLUMNS = [
    "id", "brand", "fridge_model", "price", "sales_date", "store_name",
    "customer_feedback", "feedback_rating", "feedback_sentiment_category",
]
# Columns never filtered on, and those used when no schema is given.
NOT_FILTERABLE = {"id", "embedding", "customer_feedback"}
DEFAULT_FILTERS = ["store_name", "brand", "feedback_sentiment_category"]

SAMPLE_SQL_ROWS = 10
SAMPLE_SEARCH_ROWS = 20
TOP_BRANDS = 5


def filterable_columns(schema: T.StructType | None) -> list[str]:
    """Text columns a search may be narrowed by."""
    if schema is None:
        return list(DEFAULT_FILTERS)
    return [
        f.name for f in schema.fields if isinstance(f.dataType, T.StringType) and f.name not in NOT_FILTERABLE
    ]


def collect_filters(parameters: Mapping[str, object], allowed: Sequence[str]) -> dict[str, list]:
    """Filters out of call parameters: a ``filters`` map plus columns named directly."""
    given = parameters.get("filters")
    filters = dict(given) if isinstance(given, Mapping) else {}
    for name in allowed:
        if name in parameters and name not in filters:
            value = parameters[name]
            filters[name] = value if isinstance(value, list) else [str(value)]
    return filters


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None, allowed: Sequence[str]) -> DataFrame:
    """Keep rows matching every filter; unknown columns and empty lists are ignored."""
    for name, values in (filters or {}).items():
        if name in allowed and values:
            df = df.where(F.col(name).isin(values if isinstance(values, list) else [values]))
    return df


def scored(corpus: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """Every row with its distance to the query vector."""
    return corpus.withColumn("distance", F.round(l2_distance(F.col(vector), vector_literal(query)), DECIMALS))


def nearest(
    corpus: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    filters: Mapping[str, object] | None = None,
    allowed: Sequence[str] | None = None,
    key: str = "id",
    columns: Sequence[str] | None = None,
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` rows closest to the query vector, closest first.

    The filters reach the scan, and each task keeps its own ``k`` best, so nothing
    is sorted in full. ``distance`` may be named among the columns.
    """
    names = filterable_columns(corpus.schema) if allowed is None else allowed
    narrowed = apply_filters(corpus, filters, names)
    return (
        scored(narrowed, query, vector)
        .orderBy("distance", key)
        .limit(k)
        .select(*(columns if columns is not None else RESULT_COLUMNS))
    )


# ---- many questions at once -----------------------------------------------------------------

class _Best:
    """The k closest rows seen so far for each of a block of questions."""

    def __init__(self, ids: Sequence, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = list(ids), vectors, k
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty(0), np.empty(0, dtype=object)) for _ in self.ids
        ]

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        row_norms = np.einsum("ij,ij->i", rows, rows)
        for start in range(0, len(self.ids), 256):
            block = slice(start, start + 256)
            # A matrix product rates all pairs; only possible winners are measured exactly.
            rough = row_norms[:, None] + self.norms[None, block] - 2.0 * rows @ self.vectors[block].T
            slack = 1e-8 * (1.0 + row_norms.max() + self.norms[block].max())
            if len(rows) > self.k:
                limit = np.partition(rough, self.k - 1, axis=0)[self.k - 1]
            else:
                limit = np.full(rough.shape[1], np.inf)
            for j in range(rough.shape[1]):
                self._merge(start + j, keys, rows, rough[:, j], limit[j], slack)

    def _merge(self, q: int, keys: np.ndarray, rows: np.ndarray, rough: np.ndarray, limit: float, slack: float) -> None:
        distances, found = self.found[q]
        if len(distances) == self.k:
            limit = min(limit, distances[-1] ** 2)
        chosen = np.flatnonzero(rough <= limit + slack)
        if not len(chosen):
            return
        difference = rows[chosen] - self.vectors[q]
        exact = np.round(np.sqrt(np.einsum("ij,ij->i", difference, difference)), DECIMALS)
        distances = np.concatenate([distances, exact])
        found = np.concatenate([found, keys[chosen]])
        order = np.lexsort((found, distances))[: self.k]
        self.found[q] = (distances[order], found[order])

    def frame(self, question: str, key: str) -> pd.DataFrame:
        return _frame(
            question, [i for i, (d, _) in zip(self.ids, self.found) for _ in d],
            key, [x for _, found in self.found for x in found],
            [x for d, _ in self.found for x in d],
        )


def _frame(question: str, ids: list, key: str, keys: list, distances: list) -> pd.DataFrame:
    """Keys as plain objects, whatever their type, so that Arrow reads them by the schema."""
    return pd.DataFrame(
        {
            question: pd.Series(ids, dtype=object),
            key: pd.Series(keys, dtype=object),
            "distance": pd.Series(distances, dtype=float),
        }
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def meet_chunks(held: DataFrame, copied: DataFrame, k: int, question: str, key: str, schema: str) -> DataFrame:
    """The k closest rows of a chunk for each question that comes to it.

    ``held`` has _chunk, _row and _vector, ``copied`` _chunk, _question and _asked. The rows of
    a chunk come first and stay in memory, the questions stream past them. Vectors travel as
    they are, and become doubles in the task.
    """
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts, keys, vectors = None, [], None, None
        for batch in batches:
            for at, group in batch.groupby("_chunk", sort=True):
                if at != number:
                    number, parts, keys = at, [], None
                asks = group["_asks"].to_numpy(dtype=bool)
                if not asks.all():
                    parts.append(group[~asks])
                if asks.any() and parts:
                    if keys is None:
                        chunk_rows = pd.concat(parts)
                        keys, vectors = chunk_rows["_row"].to_numpy(dtype=object), _matrix(chunk_rows["_vector"])
                    some = group[asks]
                    best = _Best(some["_question"].tolist(), _matrix(some["_asked"]), k)
                    best.add(keys, vectors)
                    yield best.frame(question, key)

    both = held.withColumn("_asks", F.lit(False)).unionByName(copied.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    return both.repartition("_chunk").sortWithinPartitions("_chunk", "_asks").mapInPandas(meet, schema)


def best_of(partial: DataFrame, k: int, question: str, key: str) -> DataFrame:
    closest = Window.partitionBy(question).orderBy("distance", key)
    return partial.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k)


def pair_schema(corpus: DataFrame, questions: DataFrame, key: str, question: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in (questions.schema[question], corpus.schema[key])}
    return f"{question} {kinds[question]}, {key} {kinds[key]}, distance double"


def nearest_batch(
    corpus: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    key: str = "id",
    question: str = "question_id",
    vector: str = "embedding",
    chunk: int = CORPUS_CHUNK,
) -> DataFrame:
    """The ``k`` closest rows for every question: ``question, key, distance, rank``.

    The corpus is written once and dealt, by hash of its keys, into chunks that a task can
    hold; the questions are copied to every chunk and stream past it block by block, each
    leaving its k best rows of the chunk. Neither side is gathered anywhere, and no pairs are
    shuffled. ``ann.nearest_in_cells`` lets questions meet only the cells that can matter.
    """
    rows = materialize(corpus.select(key, vector).where(F.col(vector).isNotNull()), "vectors")
    asked = questions.select(question, vector).where(F.col(vector).isNotNull())
    n_chunks = max(corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / (chunk / 2)))
    held = rows.select(F.pmod(F.xxhash64(key), F.lit(n_chunks)).cast("int").alias("_chunk"), F.col(key).alias("_row"), F.col(vector).alias("_vector"))
    copied = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_chunk"), F.col(question).alias("_question"), F.col(vector).alias("_asked"))
    schema = pair_schema(corpus, questions, key, question)
    return best_of(meet_chunks(held, copied, k, question, key, schema), k, question, key)


# ---- what is made of a result ---------------------------------------------------------------

def brand_histogram(
    results: DataFrame, brand: str = "brand", n: int = TOP_BRANDS, above: int = SAMPLE_SEARCH_ROWS
) -> DataFrame:
    """The brands most often found; given only when the result is longer than its sample."""
    # A search returns k rows at most, so its groups fit one window.
    everything = Window.partitionBy()
    return (
        results.groupBy(brand)
        .agg(F.count("*").alias("mentions"))
        .withColumn("_rows", F.sum("mentions").over(everything))
        .where((F.col("_rows") > above) & (F.coalesce(F.col(brand), F.lit("")) != ""))
        .orderBy(F.col("mentions").desc(), F.col(brand))
        .limit(n)
        .drop("_rows")
    )


def sample_rows(results: DataFrame, order: Sequence[str], semantic: bool = False) -> DataFrame:
    """The rows shown to a reader: 20 of a search, 10 of a statement."""
    return results.orderBy(*order).limit(SAMPLE_SEARCH_ROWS if semantic else SAMPLE_SQL_ROWS)
