"""Exact quantiles with linear interpolation.

percentile() keeps every distinct value of a group in one buffer. Here the distinct values are
counted in parallel, ranked with running_totals, and only the two neighbours of each wanted
position are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.operators.ranking import running_totals
from lendframe.operators.reshape import to_long


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, column) with the array ``q``, one entry per probability.

    A column without any value has no row.
    """
    by = list(by)
    counts = (to_long(df, cols, keep=by).where("value IS NOT NULL")
              .groupBy(*by, "column", "value").agg(F.count("*").alias("n")))
    ranked = running_totals(counts, "value", ["n"], by=[*by, "column"], bounds_by=["column"])
    first = F.col("cum_n") - F.col("n")
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("all_n") - 1)
        for side, k in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            picks.append(F.max(F.when((first <= k) & (k < F.col("cum_n")), F.col("value")))
                         .alias(f"{side}{i}"))
    found = ranked.groupBy(*by, "column").agg(F.max("all_n").alias("n"), *picks)
    values = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("n") - 1)
        values.append(F.col(f"lo{i}")
                      + (spot - F.floor(spot)) * (F.col(f"hi{i}") - F.col(f"lo{i}")))
    return found.select(*by, "column", "n", F.array(*values).alias("q"))


def fitted_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """{column: [values]} on the driver: a fitted artefact of len(cols) * len(probs) numbers."""
    return {r["column"]: list(r["q"]) for r in exact_quantiles(df, cols, probs).collect()}
