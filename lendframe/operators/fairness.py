"""Audit by group, gaps between groups, and two mitigations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.nulls import sdiv
from lendframe.operators.conformal import outcome_rates
from lendframe.operators.decisions import gain_of, totals_below
from lendframe.operators.metrics import rank_metrics

# Threshold grid 0.05, 0.0525, ..., 0.40
GRID = [round(0.05 + 0.0025 * i, 4) for i in range(141)]


def by_attribute(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, attribute) with attribute and group names; rows without a group drop out."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))
                      for a in attributes])
    return (df.select(*keep, F.explode(pairs).alias("_g"))
            .select(*keep, "_g.attribute", "_g.group").where("group IS NOT NULL"))


def audit(df: DataFrame, y: str, p: str, approved: str, attributes: Sequence[str]) -> DataFrame:
    """Per (attribute, group): size, rates, AUC and how the decision treats good and bad customers."""
    long = by_attribute(df, attributes, list(dict.fromkeys([y, p, approved])))
    keys = ["attribute", "group"]
    yes = F.col(approved).cast("double")
    rates = long.groupBy(*keys).agg(
        F.count("*").alias("applicants"), F.avg(y).alias("default_rate"),
        F.avg(p).alias("mean_predicted"), F.avg(yes).alias("approval_rate"),
        (1 - F.avg(F.when(F.col(y) == 0, yes))).alias("good_declined"),
        (1 - F.avg(F.when(F.col(y) == 1, yes))).alias("defaulters_declined"))
    return rates.join(rank_metrics(long, y, p, keys).select(*keys, "roc_auc"), on=keys)


def gaps(table: DataFrame) -> DataFrame:
    """Largest gap between groups of each attribute under four fairness definitions."""
    def spread(c: str) -> Column:
        return F.max(c) - F.min(c)
    return table.groupBy("attribute").agg(
        spread("approval_rate").alias("parity_difference"),
        spread("good_declined").alias("opportunity_gap"),
        F.greatest(spread("good_declined"), spread("defaulters_declined")).alias("odds_difference"),
        sdiv(F.min("approval_rate"), F.max("approval_rate")).alias("impact_ratio"))


def conformal_by_group(df: DataFrame, y: str, p: str, attributes: Sequence[str]) -> DataFrame:
    """Conformal outcome rates per group; df carries q_repay and q_default."""
    long = by_attribute(df, attributes, [y, p, "q_repay", "q_default"])
    return outcome_rates(long, y, p, by=["attribute", "group"])


def reweighing(df: DataFrame, y: str, group: str) -> DataFrame:
    """Adds ``weight`` = P(group) P(label) / P(group, label).

    The cell table has one row per (group, label); the rows only look their cell up.
    """
    cells = df.groupBy(group, y).agg(F.count("*").alias("_n"))
    everyone = Window.partitionBy(F.lit(0))
    table = cells.select(
        F.col(group).alias("_g"), F.col(y).alias("_y"),
        (F.sum("_n").over(Window.partitionBy(group)) * F.sum("_n").over(Window.partitionBy(y))
         / (F.sum("_n").over(everyone) * F.col("_n"))).alias("weight"))
    return (df.join(table, F.col(group).eqNullSafe(F.col("_g")) & F.col(y).eqNullSafe(F.col("_y")))
            .drop("_g", "_y"))


def _options(totals: DataFrame) -> DataFrame:
    """Per (part, group, threshold): profit and the share of good customers declined."""
    return totals.select("part", "group", "threshold", "profit",
                         (1 - sdiv(F.col("good"), F.col("all_good"))).alias("declined"))


def _choose(options: DataFrame, max_gap: float) -> DataFrame:
    """Per part: one threshold per group, most total profit, declined rates within max_gap.

    The best set has some lowest rate L, and every other group then takes its most profitable
    threshold with a rate in [L, L + max_gap]. Trying each of the groups x grid rates as L finds
    the optimum exactly, for any number of groups. Ties go to the smaller thresholds.
    """
    lows = options.select("part", F.col("declined").alias("low")).distinct()
    fits = (options.join(F.broadcast(lows), on="part")  # a few hundred rows
            .where((F.col("declined") >= F.col("low")) & (F.col("declined") - F.col("low") <= max_gap)))
    per_group = fits.groupBy("part", "low", "group").agg(
        F.min_by(F.struct("threshold", "profit"),
                 F.struct(-F.col("profit"), F.col("threshold"))).alias("pick"))
    groups = options.groupBy("part").agg(F.count_distinct("group").alias("groups"))
    sets = (per_group.groupBy("part", "low").agg(
        F.sum("pick.profit").alias("total"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("group", "pick.threshold"))).alias("choice"))
        .join(F.broadcast(groups), on="part").where("n = groups"))
    return sets.groupBy("part").agg(
        F.min_by("choice", F.struct(-F.round("total", 6), F.col("choice"))).alias("choice"),
        F.max("total").alias("total"))


def _table(chosen: DataFrame) -> DataFrame:
    return (chosen.select("part", "total", F.explode("choice").alias("_c"))
            .select("part", "_c.group", "_c.threshold", "total"))


def group_thresholds(df: DataFrame, y: str, p: str, group: str, amount: str, margin: float, lgd: float,
                     max_gap: float, grid: Sequence[float] = GRID) -> DataFrame:
    """group, threshold, total: an empty result means no set on the grid meets max_gap."""
    sums = {"profit": gain_of(y, amount, margin, lgd), "good": (F.col(y) == 0).cast("long")}
    totals = totals_below(df.withColumn("group", F.col(group)), p, grid, sums, by=["group"])
    options = _options(totals.withColumn("part", F.lit(0)))
    return _table(_choose(options, max_gap)).drop("part")


def crossfit_group_thresholds(df: DataFrame, y: str, p: str, group: str, amount: str, fold: str,
                              margin: float, lgd: float, max_gaps: Sequence[float],
                              grid: Sequence[float] = GRID) -> DataFrame:
    """(max_gap, part, group, threshold): for each fold the thresholds chosen on the other folds.

    The totals of "all other folds" are all totals minus the fold's own, so the rows are read once.
    """
    sums = {"profit": gain_of(y, amount, margin, lgd), "good": (F.col(y) == 0).cast("long")}
    per = totals_below(df.withColumns({"group": F.col(group), "part": F.col(fold)}), p, grid, sums,
                       by=["group", "part"])
    w = Window.partitionBy("group", "threshold")
    rest = per.select("group", "part", "threshold",
                      *[(F.sum(c).over(w) - F.col(c)).alias(c)
                        for c in ("profit", "good", "all_profit", "all_good")])
    out = None
    for g in max_gaps:
        part = _table(_choose(_options(rest), g)).withColumn("max_gap", F.lit(float(g)))
        out = part if out is None else out.unionByName(part)
    return out


def impossibility(df: DataFrame, y: str, declined: str, group: str) -> DataFrame:
    """Share of good customers declined, directly and from b/(1-b) (1-PPV)/PPV TPR."""
    no = F.col(declined) == 1
    base = df.groupBy(group).agg(
        F.avg(y).alias("base_rate"), F.avg(F.when(no, F.col(y))).alias("ppv"),
        F.avg(F.when(F.col(y) == 1, no.cast("double"))).alias("tpr"),
        F.avg(F.when(F.col(y) == 0, no.cast("double"))).alias("fpr"))
    b, ppv = F.col("base_rate"), F.col("ppv")
    return base.withColumns({"miss_rate": 1 - F.col("tpr"), "fpr_from_identity":
                             sdiv(b, 1 - b) * sdiv(1 - ppv, ppv) * F.col("tpr")})


def rate_interval(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Actual rate with a normal 95% interval, mean prediction and their difference per group."""
    base = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("rate"),
                                 F.avg(p).alias("mean_p"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return base.withColumns({"low": F.col("rate") - half, "high": F.col("rate") + half,
                             "gap": F.col("rate") - F.col("mean_p")})
