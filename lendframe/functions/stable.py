"""Exponentials that do not overflow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """exp(-z) may reach infinity, which gives 0; z is named once so that plans stay short."""
    return 1 / (1 + F.exp(-z))


def log_one_plus_exp(z: Column) -> Column:
    """ln(1 + e^z)"""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sum_exp(cols: list[Column]) -> Column:
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(c - top) for c in cols]))
