"""Encoders fitted on training rows and applied as plain projections.

A fitted encoder is a small dictionary (a few numbers per column); applying it adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lendframe.operators.profiling import distinct_counts
from lendframe.operators.quantiles import fitted_quantiles
from lendframe.operators.reshape import to_long
from lendframe.operators.splits import hash_fold
from lendframe.operators.joins import beside
from lendframe.session import fresh_folder


def column_groups(df: DataFrame, max_onehot: int = 10) -> DataFrame:
    """column, levels, kind: number, small text (one-hot) or large text (target encoding)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    kind = (F.when(~F.col("column").isin(*texts), "number")
            .when(F.col("levels") <= max_onehot, "small text").otherwise("large text"))
    return distinct_counts(df, df.columns).withColumn("kind", kind)


def fit_clipper(df: DataFrame, cols: Sequence[str], lower: float = 0.001, upper: float = 0.999) -> dict:
    """{column: (low, high)}; a column without values gets no cap."""
    return {c: tuple(q) for c, q in fitted_quantiles(df, cols, [lower, upper]).items()}


def clip(value: Column, caps: tuple | None) -> Column:
    """NULL stays NULL."""
    if caps is None:
        return value
    return F.when(value < caps[0], caps[0]).when(value > caps[1], caps[1]).otherwise(value)


def fit_imputer(df: DataFrame, cols: Sequence[str]) -> dict:
    """{column: (median, had missing values)}"""
    return _fills(df, cols, {c: q[0] for c, q in fitted_quantiles(df, cols, [0.5]).items()})


def _fills(df: DataFrame, cols: Sequence[str], medians: dict) -> dict:
    holes = df.agg(*[F.max(F.isnull(c).cast("int")).alias(c) for c in cols]).first()
    return {c: (medians.get(c, 0.0), bool(holes[c])) for c in cols}


def fit_scaler(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """{name: (mean, population deviation)}, a zero deviation counts as 1."""
    aggs = []
    for n, e in exprs.items():
        aggs += [F.avg(e).alias(f"m_{n}"), F.stddev_pop(e).alias(f"s_{n}")]
    row = df.agg(*aggs).first()
    return {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 1.0) for n in exprs}


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict:
    """{column: sorted levels, None first when missing values occur}: for columns with a few levels, which
    become part of an expression (`column_groups` tells which). Larger ones are looked up, see `looked_up`."""
    pairs = to_long(df, cols, kind="string").distinct().collect()
    out: dict = {c: [] for c in cols}
    for r in pairs:
        out[r["column"]].append(r["value"])
    return {c: sorted(v, key=lambda x: (x is not None, x or "")) for c, v in out.items()}


def level_numbers(df: DataFrame, column: str) -> DataFrame:
    """level, value: the place of every level in their order, from 0. Levels are sorted in ranges, so there may be any number."""
    levels = df.select(F.col(column).cast("string").alias("level")).where("level IS NOT NULL").distinct()
    levels = stored(levels.repartitionByRange("level").sortWithinPartitions("level").withColumn("at", F.monotonically_increasing_id()), "levels")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in levels.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    if not before:
        return levels.select("level", F.lit(0.0).alias("value"))
    return levels.select("level", (place + F.create_map(*before)[part]).cast("double").alias("value"))


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table, written once to the session's shared folder."""
    return df_at(table.sparkSession, path_of(table, name))


def path_of(table: DataFrame, name: str) -> str:
    path = fresh_folder(table.sparkSession, name)
    table.write.parquet(path)
    return path


def df_at(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def looked_up(df: DataFrame, tables: dict[str, str], suffix: str) -> DataFrame:
    """Adds ``<column><suffix>`` from stored tables (level, value) by a join; NULL where a level isn't known."""
    for c, path in tables.items():
        table = df_at(df.sparkSession, path).select(F.col("level").alias("_level"), F.col("value").alias(f"{c}{suffix}"))
        df = df.join(table, df[c].cast("string").eqNullSafe(table["_level"]), "left").drop("_level")
    return df


def ordinal(value: Column, levels: Sequence[str]) -> Column:
    """Position among the known levels; -1 unknown, -2 missing."""
    out = F.when(value.isNull(), F.lit(-2))
    for i, level in enumerate(x for x in levels if x is not None):
        out = out.when(value == level, F.lit(i))
    return out.otherwise(F.lit(-1))


def one_hot(value: Column, level) -> Column:
    """1 on the level; an unknown value is 0 everywhere, missing is a level of its own."""
    hit = value.isNull() if level is None else F.coalesce(value == level, F.lit(False))
    return hit.cast("double")


def target_means(df: DataFrame, column: str, label: str, smoothing: float = 10.0) -> DataFrame:
    """Label mean per level, shrunk to the overall mean by ``smoothing`` extra rows."""
    total = df.agg(F.avg(label).alias("_all"))
    return (df.groupBy(column).agg(F.sum(label).alias("_s"), F.count("*").alias("_n"))
            .transform(beside, total)  # one row
            .select(column, ((F.col("_s") + smoothing * F.col("_all")) / (F.col("_n") + smoothing)).alias("mean"),
                    "_all"))


def target_encode(df: DataFrame, key: str, column: str, label: str, n_folds: int = 5,
                  smoothing: float = 10.0, seed=42) -> DataFrame:
    """Adds ``encoded``: each row gets its level's mean over the other folds.

    (level, fold) sums are one small group-by; "the other folds" is the level total minus the own
    fold, so the rows are aggregated once and looked up once.
    """
    rows = df.withColumn("_fold", hash_fold(key, n_folds, seed))
    own = rows.groupBy(column, "_fold").agg(F.sum(label).alias("_s"), F.count("*").alias("_n"))
    level = own.groupBy(column).agg(F.sum("_s").alias("_ls"), F.sum("_n").alias("_ln"))
    fold = own.groupBy("_fold").agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    total = own.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    # with one fold only there are no other rows
    prior = F.coalesce(F.try_divide(F.col("_ts") - F.col("_fs"), F.col("_tn") - F.col("_fn")), F.lit(0.0))
    table = (own.join(level, own[column].eqNullSafe(level[column])).drop(level[column])
             .join(F.broadcast(fold), on="_fold").transform(beside, total)
             .select(F.col(column).alias("_level"), F.col("_fold").alias("_f"),
                     ((F.col("_ls") - F.col("_s") + smoothing * prior)
                      / (F.col("_ln") - F.col("_n") + smoothing)).alias("encoded")))
    return (rows.join(table, rows[column].eqNullSafe(F.col("_level")) & (F.col("_fold") == F.col("_f")))
            .drop("_level", "_f", "_fold"))


def cross_fitted(df: DataFrame, key: str, label: str, large: Sequence[str], smoothing: float = 10.0) -> DataFrame:
    """Adds ``<column>_crossed``, its target encoding over the other folds, for rows a model is fitted on."""
    for c in large:
        df = target_encode(df, key, c, label, smoothing=smoothing).withColumnRenamed("encoded", f"{c}_crossed")
    return df


def fit_linear(df: DataFrame, key: str, label: str, numeric: Sequence[str], small: Sequence[str],
               large: Sequence[str] = (), smoothing: float = 10.0) -> dict:
    """Everything the linear preprocessor learned: plain numbers, and the paths of the stored tables of target means.

    Target means are those of all rows; the scale of an encoded column is that of its cross-fitted values.
    """
    cuts = fitted_quantiles(df, numeric, [0.001, 0.5, 0.999])  # one pass for caps and medians
    caps = {c: (q[0], q[2]) for c, q in cuts.items()}
    fill = _fills(df, numeric, {c: q[1] for c, q in cuts.items()})
    filled = {c: F.coalesce(clip(F.col(c).cast("double"), caps.get(c)), F.lit(fill[c][0])) for c in numeric}
    flags = {f"{c}_missing": F.isnull(c).cast("double") for c in numeric if fill[c][1]}
    means = {}
    for c in large:
        table = target_means(df, c, label, smoothing).select(F.col(c).cast("string").alias("level"), F.col("mean").alias("value"))
        means[c] = {"path": path_of(table, "means"), "default": df.agg(F.avg(label)).first()[0] or 0.0}
    encoded = {f"{c}_rate": F.col(f"{c}_crossed") for c in large}
    crossed = cross_fitted(df, key, label, large, smoothing)
    return {"caps": caps, "fill": fill, "means": means, "levels": fit_levels(df, small) if small else {},
            "scale": fit_scaler(crossed, {**filled, **flags, **encoded}), "numeric": list(numeric),
            "small": list(small), "large": list(large)}


def with_means(df: DataFrame, fit: dict) -> DataFrame:
    """Rows to score with ``<column>_mean``, the target mean of their level over all training rows."""
    return looked_up(df, {c: m["path"] for c, m in fit["means"].items()}, "_mean")


def linear_columns(fit: dict, crossed: bool = False) -> dict[str, Column]:
    """Name -> expression of every model input, in order. One projection.

    Rows to score need the columns that `with_means` looks up.
    crossed: for the rows of `cross_fitted`, whose encoded values don't hold their own label.
    """
    def scaled(name: str, e: Column) -> Column:
        mean, dev = fit["scale"][name]
        return (e - mean) / (dev or 1.0)
    out = {}
    for c in fit["numeric"]:
        value = clip(F.col(c).cast("double"), fit["caps"].get(c))
        out[c] = scaled(c, F.coalesce(value, F.lit(fit["fill"][c][0])))
    for c in fit["numeric"]:
        if fit["fill"][c][1]:
            out[f"{c}_missing"] = scaled(f"{c}_missing", F.isnull(c).cast("double"))
    for c in fit["small"]:
        for level in fit["levels"][c]:
            out[f"{c}={level}"] = one_hot(F.col(c), level)
    for c in fit["large"]:
        value = F.col(f"{c}_crossed") if crossed else F.coalesce(F.col(f"{c}_mean"), F.lit(float(fit["means"][c]["default"])))
        out[f"{c}_rate"] = scaled(f"{c}_rate", value)
    return out
