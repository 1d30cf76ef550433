"""Aggregates across the columns of one row; missing cells are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _value(c: str) -> Column:
    return F.col(c).cast("double")


def row_count(cols: list[str]) -> Column:
    """Cells that are present."""
    return _add([F.isnotnull(F.col(c)).cast("int") for c in cols])


def row_sum(cols: list[str]) -> Column:
    """Missing cells add 0."""
    return _add([F.coalesce(_value(c), F.lit(0.0)) for c in cols])


def row_sum_or_null(cols: list[str]) -> Column:
    """As row_sum, but NULL when the row has no value at all."""
    return F.when(row_count(cols) > 0, row_sum(cols))


def row_mean(cols: list[str]) -> Column:
    return F.when(row_count(cols) > 0, row_sum(cols) / row_count(cols))


def row_std(cols: list[str]) -> Column:
    """Sample deviation; NULL with fewer than two values."""
    mean, n = row_mean(cols), row_count(cols)
    squares = _add([F.coalesce(F.pow(_value(c) - mean, 2), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def row_min(cols: list[str]) -> Column:
    return F.least(*[_value(c) for c in cols])


def row_max(cols: list[str]) -> Column:
    return F.greatest(*[_value(c) for c in cols])


def row_product(cols: list[str]) -> Column:
    """Product when every cell is present, else NULL."""
    return reduce(lambda a, b: a * b, [_value(c) for c in cols])
