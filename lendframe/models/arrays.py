"""Linear algebra between row columns and small fitted arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(cols: Sequence[str], weights: Sequence[float]) -> Column:
    """Sum of weight times column as one array fold, so wide models keep a short expression."""
    xs = F.array(*[F.col(c).cast("double") for c in cols])
    ws = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(xs, ws, lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)


def matrix(cols: Sequence[str], rows: Sequence[Sequence[float]], bias: Sequence[float]) -> list[Column]:
    return [dot(cols, r) + F.lit(float(b)) for r, b in zip(rows, bias)]


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
