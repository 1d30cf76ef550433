"""Significance tests on counts and p-values that Spark has already reduced."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p-value of k heads in n fair tosses."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-18:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact test on two 0/1 columns "this model was right": only disagreements count."""
    row = df.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"),
                 F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b")).first()
    n = row["only_a"] + row["only_b"]
    return df.sparkSession.createDataFrame(
        [(row["only_a"], row["only_b"], binomial_two_sided(row["only_a"], n))],
        "only_a_right long, only_b_right long, p_value double")


def holm(df: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values; ``family`` columns name the set of tests adjusted together."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = w.orderBy(p)
    step = (F.count("*").over(w) - F.row_number().over(order) + 1) * F.col(p)
    return (df.withColumn("_step", step)
            .withColumn("adjusted", F.least(F.lit(1.0), F.max("_step").over(
                order.rowsBetween(Window.unboundedPreceding, 0))))
            .drop("_step"))


def t5_two_sided(t: float) -> float:
    """Two-sided p-value of Student's t with 5 degrees of freedom, in closed form."""
    theta = math.atan(abs(t) / math.sqrt(5))
    inside = theta + math.sin(theta) * (math.cos(theta) + 2 / 3 * math.cos(theta) ** 3)
    return 1 - 2 / math.pi * inside


def five_by_two(differences: Sequence[Sequence[float]]) -> dict:
    """Paired t from five repetitions of two differences each."""
    variances = [(a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2 for a, b in differences]
    spread = math.sqrt(sum(variances) / len(variances))
    t = differences[0][0] / spread if spread else 0.0
    return {"t": t, "p_value": t5_two_sided(t),
            "mean_difference": sum(a + b for a, b in differences) / (2 * len(differences))}
