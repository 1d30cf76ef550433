"""Weight-of-evidence binning for scorecards: all columns in one long aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.bins import bin_index
from lendframe.operators.quantiles import exact_quantiles
from lendframe.operators.reshape import to_long

MISSING, OTHER = "(missing)", "(other)"


def _numeric_cells(df: DataFrame, y: str, cols: Sequence[str], n_bins: int) -> DataFrame:
    """column, bin, good, bad, k; the bin of a number is how many cuts are at or below it."""
    cuts = (exact_quantiles(df, cols, [i / n_bins for i in range(1, n_bins)])
            .select("column", F.array_distinct("q").alias("cuts")))
    long = to_long(df, cols, keep=[y]).join(F.broadcast(cuts), on="column", how="left")
    cuts_or_none = F.coalesce("cuts", F.array().cast("array<double>"))
    place = F.when(F.col("value").isNull(), MISSING).otherwise(
        bin_index(F.col("value"), cuts_or_none).cast("string"))
    cells = long.groupBy("column", place.alias("bin")).agg(
        F.sum((F.col(y) == 0).cast("long")).alias("good"), F.sum((F.col(y) == 1).cast("long")).alias("bad"))
    return (cells.join(F.broadcast(cuts), on="column", how="left")
            .select("column", "bin", "good", "bad", F.lit("number").alias("kind"),
                    cuts_or_none.alias("cuts"), (F.size(cuts_or_none) + 2).alias("k")))


def _text_cells(df: DataFrame, y: str, cols: Sequence[str], min_share: float) -> DataFrame:
    """Levels with a share of at least min_share of the present values keep their own bin."""
    levels = to_long(df, cols, keep=[y], kind="string").groupBy("column", "value").agg(
        F.sum((F.col(y) == 0).cast("long")).alias("good"), F.sum((F.col(y) == 1).cast("long")).alias("bad"))
    n = F.when(F.col("value").isNotNull(), F.col("good") + F.col("bad"))
    share = n / F.sum(n).over(Window.partitionBy("column"))
    name = (F.when(F.col("value").isNull(), MISSING).when(share >= min_share, F.concat(F.lit("="), F.col("value")))
            .otherwise(OTHER))
    cells = levels.withColumn("bin", name).groupBy("column", "bin").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    real = F.sum((F.col("bin") != MISSING).cast("int")).over(Window.partitionBy("column"))
    return cells.select("column", "bin", "good", "bad", F.lit("text").alias("kind"),
                        F.array().cast("array<double>").alias("cuts"), (real + 1).alias("k"))


def woe_bins(df: DataFrame, y: str, numeric: Sequence[str] = (), text: Sequence[str] = (), n_bins: int = 10,
             min_share: float = 0.01, smoothing: float = 0.5) -> DataFrame:
    """column, bin, good, bad, woe, iv. A bin without training rows is absent and counts as 0.

    ``smoothing`` is added to both counts of each of the column's k bins (missing included).
    """
    parts = []
    if numeric:
        parts.append(_numeric_cells(df, y, numeric, n_bins))
    if text:
        parts.append(_text_cells(df, y, text, min_share))
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("column")
    s = F.lit(float(smoothing))
    good = (F.col("good") + s) / (F.sum("good").over(w) + s * F.col("k"))
    bad = (F.col("bad") + s) / (F.sum("bad").over(w) + s * F.col("k"))
    out = cells.withColumns({"_g": good, "_b": bad}).withColumn("woe", F.log(F.col("_g") / F.col("_b")))
    return (out.withColumn("iv", F.sum((F.col("_g") - F.col("_b")) * F.col("woe")).over(w))
            .select("column", "kind", "bin", "good", "bad", "woe", "iv", "cuts"))


def selected(bins: DataFrame, min_iv: float = 0.02, max_features: int = 30) -> DataFrame:
    """column, iv of the kept columns, largest information value first."""
    return (bins.groupBy("column").agg(F.max("iv").alias("iv")).where(F.col("iv") >= min_iv)
            .orderBy(F.desc("iv"), "column").limit(max_features))


def fit_woe(df: DataFrame, y: str, numeric: Sequence[str] = (), text: Sequence[str] = (),
            min_iv: float = 0.02, max_features: int = 30, **options) -> dict:
    """{column: {kind, cuts, woe by bin, iv}} of the kept columns: a few numbers per column."""
    bins = woe_bins(df, y, numeric, text, **options)
    rules: dict = {}
    for r in bins.collect():
        rule = rules.setdefault(r["column"], {"kind": r["kind"], "cuts": list(r["cuts"]), "woe": {}, "iv": r["iv"]})
        rule["woe"][r["bin"]] = r["woe"]
    kept = sorted((c for c in rules if rules[c]["iv"] >= min_iv), key=lambda c: (-rules[c]["iv"], c))
    return {c: rules[c] for c in kept[:max_features]}


def bin_of(value: Column, rule: dict) -> Column:
    """Bin name of a value. Unseen text goes to "other", or to missing when there is no "other"."""
    if rule["kind"] == "number":
        cuts = F.array(*[F.lit(c) for c in rule["cuts"]]).cast("array<double>")
        return F.when(value.isNull(), MISSING).otherwise(bin_index(value.cast("double"), cuts).cast("string"))
    known = [b for b in rule["woe"] if b.startswith("=")]
    rest = OTHER if OTHER in rule["woe"] else MISSING
    text = F.concat(F.lit("="), value)
    return F.when(value.isNull(), MISSING).when(text.isin(known), text).otherwise(rest)


def _lookup(name: Column, table: dict[str, float]) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(0.0))


def woe_columns(rules: dict) -> dict[str, Column]:
    """column_woe -> expression; applying the encoder is one projection."""
    return {f"{c}_woe": _lookup(bin_of(F.col(c), r), r["woe"]) for c, r in rules.items()}


def scorecard_points(rules: dict, coefficients: Sequence[float], intercept: float, pdo: float = 20,
                     base_score: float = 600, base_odds: float = 50) -> dict:
    """{column: (points of an empty bin, {bin: points})}.

    base_score points mean odds of base_odds:1, and every pdo points double the odds. A row's score
    is the sum over its bins.
    """
    factor = pdo / math.log(2)
    share = (base_score - factor * math.log(base_odds) - factor * intercept) / len(rules)
    return {c: (share, {b: share - factor * beta * w for b, w in r["woe"].items()})
            for (c, r), beta in zip(rules.items(), coefficients)}


def points_table(spark, rules: dict, points: dict) -> DataFrame:
    """column, bin, woe, points, iv."""
    rows = [(c, b, float(rules[c]["woe"][b]), float(p), float(rules[c]["iv"]))
            for c, (_, table) in points.items() for b, p in table.items()]
    return spark.createDataFrame(rows, "column string, bin string, woe double, points double, iv double")


def score_column(rules: dict, points: dict) -> Column:
    """Total score of a row; one projection."""
    total = F.lit(0.0)
    for c, (empty, table) in points.items():
        pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
        total = total + F.coalesce(F.try_element_at(pairs, bin_of(F.col(c), rules[c])), F.lit(float(empty)))
    return total
