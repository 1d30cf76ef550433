"""Ranking, probability and threshold metrics of scored rows.

Every function takes ``by`` (groups or bootstrap replicates) and most take ``weight``. Scores are
collapsed to one row per (group, score) first, so ties are handled exactly and cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.bins import bin_index, uniform_bin
from lendframe.functions.nulls import sdiv
from lendframe.operators.quantiles import exact_quantiles
from lendframe.operators.ranking import running_totals
from lendframe.operators.joins import beside


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def score_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                weight: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """One row per distinct score: counts at it, counts at or above it, and group totals."""
    w = _weight(weight)
    cells = (df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, F.col(p).cast("double").alias("score"))
             .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
                  F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg")))
    return running_totals(cells, "score", ["pos", "neg"], by=by, descending=True,
                          bounds=bounds)


def curve_points(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, from the highest score down."""
    c = score_curve(df, y, p, by)
    return c.select(*by, "score", sdiv(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
                    sdiv(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
                    sdiv(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))


def rank_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                 weight: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """roc_auc, gini, pr_auc (average precision) and ks; NULL when only one class is present."""
    c = score_curve(df, y, p, by, weight, bounds)
    below = F.col("all_neg") - F.col("cum_neg") + F.col("neg") / 2.0
    gap = sdiv(F.col("cum_pos"), F.col("all_pos")) - sdiv(F.col("cum_neg"), F.col("all_neg"))
    hit = sdiv(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    out = c.groupBy(*by).agg(
        sdiv(F.sum(F.col("pos") * below), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
        sdiv(F.sum(F.col("pos") * hit), F.max("all_pos")).alias("pr_auc"),
        F.greatest(F.max(gap), F.lit(0.0)).alias("ks"))
    return out.withColumns({"gini": 2 * F.col("roc_auc") - 1,
                            "ks": F.when(F.col("roc_auc").isNotNull(), F.col("ks"))})


def log_loss_of(y: str, p: str) -> Column:
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))


def probability_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                        weight: str | None = None) -> DataFrame:
    """brier, log_loss, n, default_rate in one pass."""
    w = _weight(weight).cast("double")

    def mean(value: Column) -> Column:
        return sdiv(F.sum(value * w), F.sum(w))
    return df.groupBy(*by).agg(
        mean(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
        mean(log_loss_of(y, p)).alias("log_loss"),
        F.sum(_weight(weight)).alias("n"), mean(F.col(y)).alias("default_rate"))


def _with_group_row(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds per-group values; without groups ``other`` is a single row."""
    return df.join(other, on=list(by), how="left") if by else df.transform(beside, other)


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 10, strategy: str = "uniform",
                     by: Sequence[str] = ()) -> DataFrame:
    """bin, n, mean_p, rate. Bins are [a, b), equal width or equal count."""
    by = list(by)
    if strategy == "uniform":
        binned = df.withColumn("bin", uniform_bin(F.col(p), n_bins))
    elif strategy == "quantile":
        edges = (exact_quantiles(df, [p], [i / n_bins for i in range(n_bins + 1)], by=by)
                 .select(*by, F.array_distinct("q").alias("_edges")))
        inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
        binned = (_with_group_row(df, edges, by).where(F.size("_edges") > 1)
                  .withColumn("bin", bin_index(F.col(p), inner)))
    else:
        raise ValueError("strategy must be 'uniform' or 'quantile'")
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"),
                                          F.avg(y).alias("rate"))


def calibration_error(df: DataFrame, y: str, p: str, n_bins: int = 10, strategy: str = "uniform",
                      by: Sequence[str] = ()) -> DataFrame:
    """Average gap between predicted and actual rate, weighted by bin size."""
    bins = calibration_bins(df, y, p, n_bins, strategy, by)
    gap = F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))
    return bins.groupBy(*by).agg(F.coalesce(sdiv(F.sum(gap), F.sum("n")), F.lit(0.0)).alias("ece"))


def reliability_curve(df: DataFrame, y: str, p: str, n_bins: int = 10,
                      by: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins that include their right edge: bin, n, mean_p, rate."""
    by = list(by)
    edges = (exact_quantiles(df, [p], [i / n_bins for i in range(1, n_bins)], by=by)
             .select(*by, F.col("q").alias("_edges")))
    binned = _with_group_row(df, edges, by).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"),
                                          F.avg(y).alias("rate"))


def evaluate(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """All threshold-free metrics, one row per group."""
    by = list(by)
    parts = [rank_metrics(df, y, p, by), probability_metrics(df, y, p, by),
             calibration_error(df, y, p, by=by)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, on=by) if by else out.transform(beside, part)
    return out


def at_threshold(df: DataFrame, y: str, p: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates when p >= threshold is declined; undefined rates are 0."""
    flagged, bad = F.col(p) >= threshold, F.col(y) == 1
    c = F.col
    counts = df.groupBy(*by).agg(
        F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"),
        F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))
    zero = F.lit(0.0)
    rates = counts.withColumns({
        "threshold": F.lit(float(threshold)),
        "precision": F.coalesce(sdiv(c("tp"), c("tp") + c("fp")), zero),
        "recall": F.coalesce(sdiv(c("tp"), c("tp") + c("fn")), zero),
        "accuracy": sdiv(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")),
        "approval_rate": sdiv(c("fn") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))})
    return rates.withColumn("f1", F.coalesce(
        sdiv(2 * c("precision") * c("recall"), c("precision") + c("recall")), zero))


def score_histogram(df: DataFrame, p: str, n_bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by, uniform_bin(F.col(p), n_bins).alias("bin"))
            .agg(F.count("*").alias("n")))


# metric callables for bootstraps: (df, y, p, by, weight, bounds) -> by..., value
def auc_metric(df, y, p, by=(), weight=None, bounds=None) -> DataFrame:
    return rank_metrics(df, y, p, by, weight, bounds).select(*by, F.col("roc_auc").alias("value"))


def pr_auc_metric(df, y, p, by=(), weight=None, bounds=None) -> DataFrame:
    return rank_metrics(df, y, p, by, weight, bounds).select(*by, F.col("pr_auc").alias("value"))


def ks_metric(df, y, p, by=(), weight=None, bounds=None) -> DataFrame:
    return rank_metrics(df, y, p, by, weight, bounds).select(*by, F.col("ks").alias("value"))


def brier_metric(df, y, p, by=(), weight=None, bounds=None) -> DataFrame:
    return probability_metrics(df, y, p, by, weight).select(*by, F.col("brier").alias("value"))
