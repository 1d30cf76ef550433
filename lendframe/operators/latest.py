"""Latest row of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_of(cols: Sequence[Column], order: Sequence[Column]) -> Column:
    """Aggregate: the struct of ``cols`` on the row with the largest order tuple.

    It merges map-side, so a key with very many rows is no problem; a window would sort them all.
    """
    return F.max_by(F.struct(*cols), F.struct(*order))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                cols: Sequence[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(
        latest_of([F.col(c) for c in cols], [F.col(o) for o in order]).alias("_last"))
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])
