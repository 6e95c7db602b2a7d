"""Distances and text literals for array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance, accumulated in double precision."""
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def to_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]"))


def from_text(c: Column, element: str = "float") -> Column:
    return F.from_json(c, f"array<{element}>")


def has_length(c: Column, n: int) -> Column:
    return F.coalesce(F.size(c) == n, F.lit(False))
