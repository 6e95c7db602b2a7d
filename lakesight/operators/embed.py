"""Text vectors through a pluggable function, called on small batches inside the tasks."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Embed = Callable[[list[str]], Sequence[Sequence[float]]]

BATCH = 64
DIMENSION = 64
CACHED_WORDS = 200_000


def hashing_embedder(dimension: int = DIMENSION) -> Embed:
    """Signed word hashing scaled to unit length: deterministic and needs no service.

    Words lie between spaces, tabs, line breaks, vertical tabs and form feeds, which is how bytes are split.
    The first four hexadecimal digits of a word's MD5 choose the place, the fifth
    the sign. A text without words is the zero vector.
    """

    places: dict[bytes, tuple[int, int]] = {}

    def embed(texts: list[str]) -> list[np.ndarray]:
        if len(places) > CACHED_WORDS:
            places.clear()
        # The texts of a call are counted at once: each has its own range of places.
        index, sign = [], []
        for number, text in enumerate(texts):
            start = number * dimension
            for word in text.lower().encode().split():
                place = places.get(word)
                if place is None:
                    digest = hashlib.md5(word).hexdigest()
                    place = (int(digest[:4], 16) % dimension, 1 if int(digest[4], 16) % 2 == 0 else -1)
                    places[word] = place
                index.append(start + place[0])
                sign.append(place[1])
        size = len(texts) * dimension
        counts = (np.bincount(index, weights=sign, minlength=size) if index else np.zeros(size)).reshape(len(texts), dimension)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        return list((counts / np.where(norms == 0, 1, norms)[:, None]).astype(np.float32))

    return embed


def embed_column(df: DataFrame, text: str, embed: Embed, into: str = "embedding", attempts: int = 3) -> DataFrame:
    """Add the vector of a text column; NULL counts as the empty text.

    Each call gets at most 64 texts. A failed call is tried again a few times inside
    the task; beyond that Spark's own task retry takes over.
    """

    def call(texts: list[str]) -> Sequence[Sequence[float]]:
        for attempt in range(1, attempts + 1):
            try:
                return embed(texts)
            except Exception:
                if attempt == attempts:
                    raise
                time.sleep(0.2 * attempt)
        raise AssertionError("unreachable")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            out: list = []
            for start in range(0, len(texts), BATCH):
                out.extend(call(texts[start:start + BATCH]))
            yield pd.Series(out, index=batch.index, dtype=object)

    # Declared non-deterministic so that no plan rewrite evaluates the costly call twice.
    return df.withColumn(into, vectors.asNondeterministic()(F.col(text)))
