"""Class-conditional conformal decisions: approve, refer or decline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.operators.ranking import range_bounds, running_totals, with_bucket
from lendframe.operators.joins import beside
from lendframe.session import durable

PER_CLASS, EVERYONE = "one per class", "one for everyone"
#: Score ranges in which the rows of a repeat are counted; any edges give the same cut-offs.
RANGES = 512


def cutoffs(df: DataFrame, score: Column, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., alpha, q): the ceil((n+1)(1-alpha))-th smallest score, 1.0 when that is past n."""
    by = list(by)
    cells = (df.select(*by, score.cast("double").alias("score")).where("score IS NOT NULL")
             .groupBy(*by, "score").agg(F.count("*").alias("n")))
    ranked = running_totals(cells, "score", ["n"], by=by)
    picks = []
    for i, a in enumerate(alphas):
        k = F.ceil((F.col("all_n") + 1) * F.lit(1 - a))
        picks.append(F.coalesce(F.min(F.when(F.col("cum_n") >= k, F.col("score"))), F.lit(1.0))
                     .alias(f"q{i}"))
    wide = ranked.groupBy(*by).agg(*picks)
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"q{i}").alias("q"))
                     for i, a in enumerate(alphas)])
    return wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.alpha", "_r.q")


def true_label_score(y: str, p: str) -> Column:
    return F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))


def class_cutoffs(df: DataFrame, y: str, p: str, alphas: Sequence[float],
                  by: Sequence[str] = ()) -> DataFrame:
    """(by..., alpha, q_repay, q_default): one cut-off per true class; 1.0 for an absent class."""
    each = cutoffs(df.where(F.col(y).isNotNull()), true_label_score(y, p), alphas, by=[*by, y])
    return each.groupBy(*by, "alpha").agg(
        F.coalesce(F.max(F.when(F.col(y) == 0, F.col("q"))), F.lit(1.0)).alias("q_repay"),
        F.coalesce(F.max(F.when(F.col(y) == 1, F.col("q"))), F.lit(1.0)).alias("q_default"))


def one_cutoff(df: DataFrame, y: str, p: str, alphas: Sequence[float],
               by: Sequence[str] = ()) -> DataFrame:
    """The same cut-off for both classes, for comparison."""
    return cutoffs(df, true_label_score(y, p), alphas, by).select(
        *by, "alpha", F.col("q").alias("q_repay"), F.col("q").alias("q_default"))


def decide(p: Column, q_repay: Column, q_default: Column) -> Column:
    """Only "repay" plausible -> approve, only "default" -> decline, both or neither -> refer."""
    repay, default = p <= q_repay, 1 - p <= q_default
    return (F.when(repay & ~default, "approve").when(default & ~repay, "decline").otherwise("refer"))


def outcome_rates(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage per class, error rates and decision shares; df carries q_repay and q_default."""
    good, bad = F.col(y) == 0, F.col(y) == 1
    d = decide(F.col(p), F.col("q_repay"), F.col("q_default"))

    def rate(cond: Column, inside: Column) -> Column:
        return F.avg(F.when(inside, cond.cast("double")))
    return df.groupBy(*by).agg(
        rate(F.col(p) <= F.col("q_repay"), good).alias("coverage_repay"),
        rate(1 - F.col(p) <= F.col("q_default"), bad).alias("coverage_default"),
        rate(d == "approve", bad).alias("defaulters_approved"),
        rate(d == "decline", good).alias("good_declined"),
        *[F.avg((d == k).cast("double")).alias(f"share_{k}") for k in ("approve", "refer", "decline")])


def alpha_sweep(fit: DataFrame, held: DataFrame, y: str, p: str, alphas: Sequence[float]) -> DataFrame:
    """Cut-offs from ``fit``, outcome rates on ``held`` for each alpha (a short list)."""
    table = class_cutoffs(fit, y, p, alphas)
    return outcome_rates(held.transform(beside, table), y, p,
                         by=["alpha", "q_repay", "q_default"])


def cross_with_money_rule(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """Share of rows and default rate per (conformal decision, money decision)."""
    conformal = decide(F.col(p), F.col("q_repay"), F.col("q_default")).alias("conformal")
    money = F.when(F.col(p) < threshold, "approve").otherwise("decline").alias("money_rule")
    cells = df.groupBy(conformal, money).agg(F.count("*").alias("n"), F.avg(y).alias("default_rate"))
    total = df.agg(F.count("*").alias("_all"))
    return (cells.transform(beside, total)
            .select("conformal", "money_rule", "n", (F.col("n") / F.col("_all")).alias("share"),
                    "default_rate"))


def _half_cutoffs(fit: DataFrame, y: str, p: str, alpha: float) -> DataFrame:
    """(repeat, method, class, q): the order statistic per repeat and class, and per repeat for everyone (class NULL).

    Rows are counted per score range, which merges map-side; only those in the range that holds a
    cut-off are ordered, so the copies of the repeats are never shuffled.
    """
    scored = fit.select("repeat", F.col(y).alias("_y"), true_label_score(y, p).cast("double").alias("_s")).where("_s IS NOT NULL")
    one = scored.select("repeat").first()  # the scores of any repeat are spread like those of all
    edges = range_bounds(scored.where(F.col("repeat").eqNullSafe(F.lit(one["repeat"]))), "_s", RANGES) if one else []
    placed = with_bucket(scored, "_s", edges, "_range")
    keys = ["repeat", "method", "class"]
    groups = F.array(F.struct(F.lit(PER_CLASS).alias("method"), F.col("_y").alias("class")),
                     F.struct(F.lit(EVERYONE).alias("method"), F.lit(None).cast(fit.schema[y].dataType).alias("class")))
    counted = (placed.groupBy("repeat", "_y", "_range").agg(F.count("*").alias("_n"))
               .select("repeat", "_range", "_n", F.explode(groups).alias("_g")).select("repeat", "_g.*", "_range", "_n")
               .where((F.col("method") == EVERYONE) | F.col("class").isNotNull())
               .groupBy(*keys, "_range").agg(F.sum("_n").alias("_n")))
    group = Window.partitionBy(*keys)
    k = F.ceil((F.sum("_n").over(group) + 1) * F.lit(1 - alpha))
    upto = F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.when(F.col("_upto") >= F.col("_k"), F.struct("_range", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("place")))
    # a row a repeat and group: the range with the cut-off and its place there, NULL past the last row
    targets = durable(counted.withColumns({"_k": k, "_upto": upto}).groupBy(*keys).agg(F.min(reached).alias("_at")))
    wanted = targets.select(F.col("repeat").alias("_r"), "method", "class", F.col("_at._range").alias("_in"), F.col("_at.place").alias("place"))
    inside = placed.join(F.broadcast(wanted), F.col("repeat").eqNullSafe(F.col("_r")) & (F.col("_range") == F.col("_in"))
                         & ((F.col("method") == EVERYONE) | (F.col("class") == F.col("_y"))))
    cells = inside.groupBy(*keys, "place", "_s").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(group.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    found = cells.withColumn("_upto", upto).where("_upto >= place").groupBy(*keys).agg(F.min("_s").alias("q"))
    missing = targets.where("_at IS NULL").select(*keys, F.lit(1.0).alias("q"))
    return durable(found.unionByName(missing))


def half_split_stability(splits: DataFrame, y: str, p: str, alpha: float) -> DataFrame:
    """Per repeat: cut-offs on the fitting half, outcome rates on the other half, both methods.

    Cut-offs are those of `class_cutoffs` and `one_cutoff`; ``splits`` holds every row once a repeat, so
    it is read in passes that shuffle sums only.
    """
    cuts, held = _half_cutoffs(splits.where("fit = 1"), y, p, alpha), splits.where("fit = 0")

    def cut(label: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("class") == label, F.col("q"))), F.lit(1.0))
    per_class = cuts.where(F.col("method") == PER_CLASS).groupBy("repeat").agg(cut(0).alias("q_repay"), cut(1).alias("q_default"))
    everyone = cuts.where(F.col("method") == EVERYONE).select("repeat", F.col("q").alias("q_repay"), F.col("q").alias("q_default"))
    parts = [outcome_rates(held.join(F.broadcast(table), on="repeat"), y, p, by=["repeat"]).withColumn("method", F.lit(method))
             for method, table in ((PER_CLASS, per_class), (EVERYONE, everyone))]
    return parts[0].unionByName(parts[1])
