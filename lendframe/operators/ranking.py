"""Ordered totals and ranks over whole tables without a one-task window.

The key range is cut into buckets; only the per-bucket totals (one short row each) are summed in
order, and every bucket then adds its own offset. A value held by many rows is one row before it
gets here, because callers collapse to distinct values first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lendframe.functions.hashing import seeded_hash
from lendframe.session import width

ACCURACY = 10000
BLOCK = 64


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner bucket edges from a mergeable quantile sketch (at most ``buckets`` numbers)."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, ACCURACY).alias("e")).first()
    return sorted(set(found["e"] or []))


def with_bucket(df: DataFrame, column: str, bounds: list[float], out: str) -> DataFrame:
    if len(bounds) == 0:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=f"{out}_in", outputCol=f"{out}_raw")
    return (cut.transform(df.withColumn(f"{out}_in", F.col(column).cast("double")))
            .withColumn(out, F.col(f"{out}_raw").cast("int")).drop(f"{out}_raw", f"{out}_in"))


def _key_bounds(df: DataFrame, keys: list[str], column: str, buckets: int) -> DataFrame:
    """Bucket edges for each key; one short array per column name, so small enough to broadcast."""
    shares = [i / buckets for i in range(1, buckets)]
    rows = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(column).cast("double"), shares, ACCURACY).alias("_edges")).collect()
    schema = (df.select(*keys).schema.add("_edges", ArrayType(DoubleType()))
              .add("_marks", ArrayType(DoubleType())))
    data = []
    for r in rows:
        edges = sorted(set(r["_edges"] or []))
        # every BLOCK-th edge: a value is placed among these first, then inside one block
        data.append((*[r[k] for k in keys], edges, edges[BLOCK - 1::BLOCK]))
    return df.sparkSession.createDataFrame(data, schema)


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, bounds_by: Sequence[str] = (),
                   bounds: list[float] | None = None) -> DataFrame:
    """Adds ``cum_<s>`` (this row included) and ``all_<s>`` for every column in ``sums``.

    Rows must be distinct on (by, order) and ``order`` must not be NULL. ``bounds_by`` names the
    few-valued key (a column name) whose values live on different scales. ``bounds`` are bucket
    edges already known from a cheaper table with the same range.
    """
    buckets = width(df.sparkSession)
    by = list(by)
    if bounds_by:
        edges = _key_bounds(df, list(bounds_by), order, buckets)
        work = (df.join(F.broadcast(edges), on=list(bounds_by))
                .withColumn("_block", F.size(F.filter("_marks", lambda e: e <= F.col(order).cast("double"))))
                .withColumn("_bucket", F.col("_block") * BLOCK + F.size(F.filter(
                    F.slice("_edges", F.col("_block") * BLOCK + 1, F.lit(BLOCK)),
                    lambda e: e <= F.col(order).cast("double"))))
                .drop("_edges", "_marks", "_block"))
    else:
        edges = range_bounds(df, order, buckets) if bounds is None else bounds
        work = with_bucket(df, order, edges, "_bucket")

    first = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = across.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    totals = (work.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
              .select(*by, "_bucket",
                      *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_off_{s}")
                        for s in sums],
                      *[F.sum(f"_t_{s}").over(across).alias(f"all_{s}") for s in sums]))
    if not by:
        totals = F.broadcast(totals)  # at most one row per bucket

    inside = (Window.partitionBy(*by, "_bucket")
              .orderBy(F.col(order).desc() if descending else F.col(order).asc())
              .rowsBetween(Window.unboundedPreceding, 0))
    joined = work.join(totals, on=[*by, "_bucket"])
    return (joined.withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"_off_{s}")
                                for s in sums})
            .drop("_bucket", *[f"_off_{s}" for s in sums]))


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = (), seed=42) -> DataFrame:
    """Seeded random order inside each group: adds ``hash_rank`` (from 1) and ``group_rows``.

    Buckets are the first hex digits of the key's hash, so a group that holds most of the table
    is still spread over 4,096 small windows.
    """
    by = list(by)
    work = (df.withColumn("_hash", seeded_hash(F.col(key), seed))
            .withColumn("_bucket", F.substring("_hash", 1, 3)))
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (work.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
              .select(*[F.col(b).alias(f"_by_{b}") for b in by],
                      F.col("_bucket").alias("_bucket2"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                      F.sum("_n").over(across).alias("group_rows")))
    if not by:
        totals = F.broadcast(totals)  # at most 4,096 rows
    match = F.col("_bucket") == F.col("_bucket2")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    return (work.join(totals, match)
            .withColumn("hash_rank", F.row_number().over(inside) + F.col("_off"))
            .drop("_hash", "_bucket", "_bucket2", "_off", *[f"_by_{b}" for b in by]))
