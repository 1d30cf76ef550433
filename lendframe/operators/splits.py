"""Seeded splits and samples. Order is by key hash, so any cluster draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.hashing import hash_uniform, hex_int, seeded_hash
from lendframe.operators.ranking import hash_rank
from lendframe.operators.joins import beside


def _cut(rows: Column, share: float) -> Column:
    return F.floor(rows * F.lit(float(share)) + 0.5)


def make_splits(app: DataFrame, test_size: float = 0.20, conformal_size: float = 0.10,
                valid_size: float = 0.10, n_folds: int = 5, seed=42, key: str = "SK_ID_CURR",
                label: str = "TARGET", group: str = "CODE_GENDER", drop_group: str = "XNA") -> DataFrame:
    """Label-stratified test / conformal / valid / train split; train rows get folds 1..n_folds.

    Shares and folds are exact inside each label because they are cut from an exact rank.
    """
    kept = app.where(F.coalesce(F.col(group) != drop_group, F.lit(True))).select(key, label)
    ranked = hash_rank(kept, key, by=[label], seed=seed)
    n, r = F.col("group_rows"), F.col("hash_rank")
    ends = [_cut(n, test_size), _cut(n, test_size + conformal_size),
            _cut(n, test_size + conformal_size + valid_size)]
    split = (F.when(r <= ends[0], "test").when(r <= ends[1], "conformal")
             .when(r <= ends[2], "valid").otherwise("train"))
    fold = F.when(r > ends[2], (r - ends[2] - 1) % n_folds + 1).otherwise(-1)
    return ranked.select(key, label, split.alias("split"), fold.cast("int").alias("fold"))


def summarize(splits: DataFrame, by: str = "split", label: str = "TARGET",
              women: Column | None = None) -> DataFrame:
    """Rows, share, label rate and optionally the share of women per split or fold."""
    extra = [F.round(100 * F.avg(women), 1).alias("women_pct")] if women is not None else []
    counts = splits.groupBy(by).agg(F.count("*").alias("rows"),
                                    F.round(100 * F.avg(label), 2).alias("default_rate_pct"), *extra)
    total = splits.agg(F.count("*").alias("_all"))
    return (counts.transform(beside, total)  # one row
            .withColumn("share_pct", F.round(100 * F.col("rows") / F.col("_all"), 1)).drop("_all"))


def sample_rows(df: DataFrame, key: str, n: int | None = None, share: float | None = None,
                by: Sequence[str] = (), seed=42) -> DataFrame:
    """First n rows (or a share) in hash order; a smaller sample is part of every larger one."""
    ranked = hash_rank(df, key, by=by, seed=seed)
    limit = F.lit(n) if n is not None else _cut(F.col("group_rows"), share)
    return ranked.where(F.col("hash_rank") <= limit).drop("hash_rank", "group_rows")


def nested_shares(df: DataFrame, key: str, shares: Sequence[float], seed=42) -> DataFrame:
    """Every row with the smallest share that contains it (NULL past the largest)."""
    ranked = hash_rank(df, key, seed=seed)
    out = F.lit(None).cast("double")
    for s in sorted(shares, reverse=True):
        out = F.when(F.col("hash_rank") <= _cut(F.col("group_rows"), s), F.lit(float(s))).otherwise(out)
    return ranked.withColumn("first_share", out).drop("hash_rank", "group_rows")


def undersample(df: DataFrame, key: str, label: str, ratio: float = 0.5, seed=42) -> DataFrame:
    """All positives and floor(positives / ratio) negatives."""
    ranked = hash_rank(df, key, by=[label], seed=seed)
    room = df.agg(F.floor(F.sum(F.col(label)) / F.lit(float(ratio))).alias("_room"))
    keep = (F.col(label) == 1) | (F.col("hash_rank") <= F.col("_room"))
    return (ranked.transform(beside, room).where(keep)  # one row
            .drop("hash_rank", "group_rows", "_room"))


def half_splits(df: DataFrame, key: str, repeats: int = 100, seed=42) -> DataFrame:
    """``repeats`` copies of the rows, each with a fair coin ``fit`` (1 = fitting half).

    One hash serves 32 repeats: its hex digits are the coins.
    """
    coins = F.concat(*[seeded_hash(F.col(key), f"{seed}:{b}") for b in range((repeats + 31) // 32)])
    return (df.withColumn("_coins", coins)
            .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
            .withColumn("fit", (F.substring(F.col("_coins"), F.col("repeat"), F.lit(1)) < "8").cast("int"))
            .drop("_coins"))


def hash_fold(key: str, n_folds: int, seed=42) -> Column:
    """Fold 0..n_folds-1 from the key alone."""
    return hex_int(seeded_hash(F.col(key), seed)) % n_folds


def hash_share(key: str, seed=42) -> Column:
    return hash_uniform(F.col(key), seed)
