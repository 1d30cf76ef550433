"""Wide to long, so that one job serves every column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            kind: str = "double") -> DataFrame:
    """One row per (row, column): keep..., column, value."""
    typed = df.select(*keep, *[F.col(c).cast(kind).alias(c) for c in cols])
    return typed.unpivot(list(keep), list(cols), "column", "value")
