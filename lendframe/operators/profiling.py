"""Data quality: every report is one pass over the rows, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.nulls import safe_corr, sdiv
from lendframe.operators.quantiles import exact_quantiles
from lendframe.operators.ranking import running_totals
from lendframe.operators.reshape import to_long
from lendframe.operators.joins import beside

SENTINEL = 365243


def _stack(df: DataFrame, cols: Sequence[str], figures: dict) -> DataFrame:
    """One aggregate row with ``name(column)`` figures -> one row per column."""
    aggs = [make(c).alias(f"{name}|{c}") for c in cols for name, make in figures.items()]
    row = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"`{name}|{c}`").cast("double").alias(name) for name in figures])
                     for c in cols])
    return row.select(F.inline(rows))


def key_checks(df: DataFrame, key: str) -> DataFrame:
    """rows, distinct keys, missing keys, repeated keys."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    known = F.col(key).isNotNull()
    return per.agg(F.sum("n").alias("rows"), F.count_if(known).alias("keys"),
                   F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
                   F.count_if(known & (F.col("n") > 1)).alias("repeated"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are in both tables."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))


def missing_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = _stack(df, cols, {"missing_share": lambda c: F.avg(F.isnull(c).cast("double"))})
    return out.withColumn("over_half", (F.col("missing_share") > 0.5).cast("int"))


def label_rate_by_missing(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Label rate of rows with and without each column, with the row counts."""
    y = F.col(label)
    return _stack(df.where(y.isNotNull()), cols, {
        "n_missing": lambda c: F.count_if(F.isnull(c)),
        "rate_missing": lambda c: F.avg(F.when(F.isnull(c), y)),
        "rate_present": lambda c: F.avg(F.when(F.isnotnull(c), y))})


def day_columns(df: DataFrame, cols: Sequence[str], sentinel: int = SENTINEL) -> DataFrame:
    """Sentinel count and the range of the real values in days and years."""
    def real(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(sentinel))
    return _stack(df, cols, {
        "sentinels": lambda c: F.count_if(F.col(c) == sentinel),
        "min_days": lambda c: F.min(real(c)), "max_days": lambda c: F.max(real(c)),
        "min_years": lambda c: F.min(real(c)) / 365.25})


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value, NULL included."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return (counts.transform(beside, total)  # one row
            .select("value", "n", (F.col("n") / F.col("_all")).alias("share")))


def near_constant(df: DataFrame, cols: Sequence[str], limit: float = 0.99) -> DataFrame:
    """Share of the most frequent value of each column; NULL counts as a value."""
    counts = to_long(df, cols, kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return (counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"))
            .withColumn("near_constant", (F.col("top_share") > limit).cast("int")))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-missing values per column, from one shuffle of (column, value) pairs."""
    values = to_long(df, cols, kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(F.count("value").alias("levels"))


def informative_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least two different values, in their order."""
    found = {r["column"] for r in distinct_counts(df, cols).where("levels > 1").collect()}
    return [c for c in cols if c in found]


def quantile_profile(df: DataFrame, cols: Sequence[str],
                     probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    return exact_quantiles(df, cols, probs)


def compare_sets(a: DataFrame, b: DataFrame, cols: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Share of every text value in two tables; for numeric columns the means."""
    both = (to_long(a, cols, kind="string").withColumn("side", F.lit("a"))
            .unionByName(to_long(b, cols, kind="string").withColumn("side", F.lit("b"))))
    counts = both.groupBy("column", "value").agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    w = Window.partitionBy("column")
    shares = counts.select("column", "value",
                           (F.col("na") / F.sum("na").over(w)).alias("in_a"),
                           (F.col("nb") / F.sum("nb").over(w)).alias("in_b"))
    if not numeric:
        return shares
    means = (_stack(a, numeric, {"in_a": F.avg}).join(_stack(b, numeric, {"in_b": F.avg}), on="column")
             .select("column", F.lit("(mean)").alias("value"), "in_a", "in_b"))
    return shares.unionByName(means)


def spearman_with_label(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Rank correlation of each numeric column with a 0/1 label over rows where both exist.

    Rows are counted per (column, value, label); average ranks come from the running counts, and
    the correlation is a weighted sum over distinct values. A 0/1 label needs no ranks of its own.
    """
    cells = (to_long(df.where(F.col(label).isNotNull()), cols, keep=[label]).where("value IS NOT NULL")
             .groupBy("column", "value").agg(F.count("*").alias("n"), F.sum(label).alias("bad")))
    ranked = running_totals(cells, "value", ["n", "bad"], by=["column"], bounds_by=["column"])
    r = F.col("cum_n") - (F.col("n") - 1) / 2.0 - (F.col("all_n") + 1) / 2.0  # rank minus mean rank
    sums = ranked.groupBy("column").agg(
        F.max("all_n").alias("n"), F.max("all_bad").alias("bad"),
        F.sum(F.col("n") * r * r).alias("rr"), F.sum(F.col("bad") * r).alias("ry"))
    yy = F.col("bad") - F.col("bad") * F.col("bad") / F.col("n")
    return sums.select("column", sdiv(F.col("ry"), F.sqrt(F.col("rr") * yy)).alias("rho"))


def correlated_pairs(df: DataFrame, cols: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Column pairs whose absolute Pearson correlation is above the limit; one aggregate."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(rows)).where(F.abs("r") > limit)


def label_rate_by_value(df: DataFrame, column: str, label: str, top: int = 15,
                        min_count: int = 100) -> DataFrame:
    """Label rate of the most frequent values that have at least ``min_count`` rows."""
    return (df.groupBy(F.col(column).cast("string").alias("value"))
            .agg(F.count(label).alias("n"), F.avg(label).alias("rate"))
            .where((F.col("n") >= min_count) & F.col("value").isNotNull())
            .orderBy(F.desc("n"), "value").limit(top))


def table_coverage(base: DataFrame, tables: dict[str, DataFrame], label: str,
                   key: str = "SK_ID_CURR") -> DataFrame:
    """Per table: share of applicants with rows, label rate with and without."""
    flags = base.select(key, label)
    for name, df in tables.items():
        flags = flags.join(df.select(key).distinct().withColumn(name, F.lit(1)), on=key, how="left")
    y = F.col(label)
    out = _stack(flags, list(tables), {
        "covered_share": lambda c: F.avg(F.isnotnull(c).cast("double")),
        "rate_with": lambda c: F.avg(F.when(F.isnotnull(c), y)),
        "rate_without": lambda c: F.avg(F.when(F.isnull(c), y))})
    return out.withColumnRenamed("column", "table")


def cross_shares(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Cross-tab as shares of all rows."""
    total = df.agg(F.count("*").alias("_all"))
    wide = df.groupBy(rows).pivot(cols, list(values)).count()
    return wide.transform(beside, total).select(
        rows, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / F.col("_all")).alias(v) for v in values])
