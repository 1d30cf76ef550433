"""Synthetic positives between a positive row and one of its nearest positive rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.hashing import hash_uniform
from lendframe.operators.neighbours import nearest


def synthetic_positives(df: DataFrame, key: str, label: str, numeric: Sequence[str], codes: Sequence[str] = (),
                        ratio: float = 0.5, k: int = 5, seed=42) -> DataFrame:
    """New rows only: base, partner, gap, the numeric columns and the code columns.

    round(ratio * negatives) - positives rows are made. Row j takes its base in turn, so every
    positive is used equally often up to one; partner and gap are seeded draws from (base, turn).
    Numbers lie on the segment, codes come from the nearer parent.
    """
    n = df.agg(F.sum(F.col(label)).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    positives = n["pos"] or 0
    wanted = int(round(ratio * n["neg"])) - positives
    if wanted <= 0 or positives < 2:
        return df.limit(0).select(F.col(key).alias("base"), F.col(key).alias("partner"),
                                  F.lit(0.0).alias("gap"), *numeric, *codes)
    k = min(k, positives - 1)
    minority = df.where(F.col(label) == 1)
    points = minority.select(F.col(key).cast("long").alias("id"),
                             F.array(*[F.col(c).cast("double") for c in numeric]).alias("v"))
    near = (nearest(points, points, k, same=True).groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("near")))  # k entries
    full, rest = divmod(wanted, positives)
    # the first `rest` positives in hash order make one row more than the others
    from lendframe.operators.ranking import hash_rank
    turns = F.sequence(F.lit(1), F.lit(full) + (F.col("hash_rank") <= rest).cast("int"))
    draws = (hash_rank(minority.select(F.col(key).cast("long").alias("base")), "base", seed=seed)
             .where((F.lit(full) + (F.col("hash_rank") <= rest).cast("int")) > 0)
             .select("base", F.explode(turns).alias("turn"))
             .join(near, F.col("base") == F.col("qid"))
             .withColumn("gap", hash_uniform(F.concat_ws(":", "base", "turn"), f"{seed}:gap"))
             .withColumn("pick", F.floor(hash_uniform(F.concat_ws(":", "base", "turn"), f"{seed}:pick")
                                         * F.size("near")).cast("int"))
             .select("base", "turn", "gap", F.col("near")[F.col("pick")]["id"].alias("partner")))
    a = minority.select(F.col(key).cast("long").alias("base"), *[F.col(c).alias(f"a_{c}") for c in [*numeric, *codes]])
    b = minority.select(F.col(key).cast("long").alias("partner"), *[F.col(c).alias(f"b_{c}") for c in [*numeric, *codes]])
    both = draws.join(a, on="base").join(b, on="partner")
    return both.select(
        "base", "partner", "gap",
        *[(F.col(f"a_{c}") + F.col("gap") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in numeric],
        *[F.when(F.col("gap") > 0.5, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in codes])
