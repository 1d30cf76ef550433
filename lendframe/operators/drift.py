"""Population stability: bin shares of new rows against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.operators.quantiles import exact_quantiles
from lendframe.operators.reshape import to_long
from lendframe.session import durable

# The share an empty bin counts as, and the two status limits
FLOOR = 1e-4
WATCH, SHIFT = 0.1, 0.25


def status(value: Column) -> Column:
    return F.when(value < WATCH, "stable").when(value <= SHIFT, "watch").otherwise("shift")


def _index(counts: DataFrame) -> DataFrame:
    """(column, bin, ref, new) -> (column, psi). A bin empty on both sides adds nothing."""
    w = Window.partitionBy("column")
    shares = {s: F.greatest(F.col(s) / F.sum(s).over(w), F.lit(FLOOR)) for s in ("ref", "new")}
    p, q = F.col("ref"), F.col("new")
    return (counts.withColumns(shares).groupBy("column")
            .agg(F.sum((q - p) * F.log(q / p)).alias("psi")))


def _sides(reference: DataFrame, new: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    return (to_long(reference, cols, kind=kind).withColumn("is_new", F.lit(0))
            .unionByName(to_long(new, cols, kind=kind).withColumn("is_new", F.lit(1))))


def _count(side: int) -> Column:
    return F.sum((F.col("is_new") == side).cast("long"))


def _edges(reference: DataFrame, cols: Sequence[str], n_bins: int) -> DataFrame:
    return (exact_quantiles(reference, cols, [i / n_bins for i in range(1, n_bins)])
            .select("column", F.array_distinct("q").alias("edges")))


def _binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Long rows with their bin; -1 is missing."""
    place = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    return rows.join(F.broadcast(edges), on="column", how="left").withColumn("bin", place)


def numeric_bins(reference: DataFrame, new: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Rows per (column, bin) on both sides; edges are the reference's inner quantiles, -1 is missing."""
    rows = _binned(_sides(reference, new, cols, "double"), _edges(reference, cols, n_bins))
    return rows.groupBy("column", "bin").agg(_count(0).alias("ref"), _count(1).alias("new"))


def psi_by(reference: DataFrame, new: DataFrame, by: str, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """by, column, psi, status of every group of new rows against one reference.

    Edges and reference counts are made once and new rows are read once, whatever the number of groups.
    Only counts are paired with groups: groups x columns x bins rows.
    """
    edges = _edges(reference, cols, n_bins)
    ref = _binned(to_long(reference, cols), edges).groupBy("column", "bin").agg(F.count("*").alias("n"))
    now = durable(_binned(to_long(new, cols, keep=[by]), edges).groupBy(by, "column", "bin").agg(F.count("*").alias("n")))
    paired = now.groupBy("column").agg(F.collect_set(by).alias(by)).join(ref, on="column")
    both = (paired.select(F.explode(by).alias(by), "column", "bin", F.col("n").alias("ref"), F.lit(0).alias("new"))
            .unionByName(now.select(by, "column", "bin", F.lit(0).alias("ref"), F.col("n").alias("new"))))
    counts = both.groupBy(by, "column", "bin").agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))
    out = _index(counts.withColumn("column", F.struct(by, "column")))
    return out.select(f"column.{by}", "column.column", "psi").withColumn("status", status(F.col("psi")))


def text_bins(reference: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One bin per reference level, one for missing, one for levels the reference never had."""
    levels = (_sides(reference, new, cols, "string").groupBy("column", "value")
              .agg(_count(0).alias("ref"), _count(1).alias("new")))
    name = (F.when(F.col("value").isNull(), "(missing)").when(F.col("ref") == 0, "(unseen)")
            .otherwise(F.concat(F.lit("="), F.col("value"))))
    return levels.groupBy("column", name.alias("bin")).agg(F.sum("ref").alias("ref"),
                                                           F.sum("new").alias("new"))


def psi_table(reference: DataFrame, new: DataFrame, numeric: Sequence[str] = (),
              text: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """column, psi, status for all columns in one pass per kind."""
    parts = []
    if numeric:
        parts.append(_index(numeric_bins(reference, new, numeric, n_bins)))
    if text:
        parts.append(_index(text_bins(reference, new, text)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("status", status(F.col("psi")))
