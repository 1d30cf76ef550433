"""Key joins with the checks a feature table needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, few: DataFrame) -> DataFrame:
    """Puts a table of a few rows (one row of totals, or a short list of settings) next to every row.

    Only for tables whose size does not depend on the data; they are broadcast.
    """
    return df.crossJoin(F.broadcast(few))


def attach(base: DataFrame, part: DataFrame, count_cols: Sequence[str], flag_name: str,
           key: str = "SK_ID_CURR") -> DataFrame:
    """Left join of one table's features: counts get 0 and the flag tells who had rows.

    ``part`` comes from a group-by on the key, so the join adds no rows and reuses its exchange.
    """
    names = [c for c in part.columns if c != key]
    joined = base.join(part.withColumn(flag_name, F.lit(1)), on=key, how="left")
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in count_cols else F.col(c)
              for c in names]
    return joined.select(*base.columns, *filled,
                         F.coalesce(F.col(flag_name), F.lit(0)).cast("int").alias(flag_name))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Fails at run time on a repeated key. The repeated keys are counted in parallel."""
    repeats = (df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
               .agg(F.count("*").alias("repeats")))
    bad = repeats.first()["repeats"]
    if bad:
        raise ValueError(f"{bad} values of {key} occur more than once")
    return df


def lookup(df: DataFrame, table: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Value lookup by key; rows without a match get NULL."""
    return df.join(table.select(key, *cols), on=key, how="left")


def share_absent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``a`` are missing in ``b``."""
    left = a.select(key).where(F.col(key).isNotNull()).distinct()
    right = b.select(key).distinct().withColumn("_hit", F.lit(1))
    return (left.join(right, on=key, how="left")
            .agg(F.count("*").alias("ids"),
                 F.sum(F.isnull("_hit").cast("bigint")).alias("absent"))
            .withColumn("absent_share", F.try_divide(F.col("absent"), F.col("ids"))))


def keys_of(splits: DataFrame, features: DataFrame, split: str, sensitive: Sequence[str] = (),
            key: str = "SK_ID_CURR", drop: Sequence[str] = ("TARGET", "is_test"),
            include_sensitive: bool = False) -> DataFrame:
    """Model rows of one split: key, fold, TARGET and the feature columns."""
    rows = splits.where(F.col("split") == split).select(key, "fold", "TARGET")
    hidden = set(drop) | {key} | (set() if include_sensitive else set(sensitive))
    cols = [c for c in features.columns if c not in hidden]
    return rows.join(features.select(key, *cols), on=key, how="left")
