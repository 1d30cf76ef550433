"""Additive contributions of features to a score, and what is read from them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.nulls import safe_corr
from lendframe.functions.text import family_of, feature_label, format_value, reason_sentence
from lendframe.operators.joins import beside


def linear_contributions(columns: dict[str, Column], coefficients: Sequence[float],
                         means: Sequence[float]) -> Column:
    """Array of (feature, value, impact), impact = coefficient * (value - mean); stays in the row."""
    return F.array(*[F.struct(F.lit(n).alias("feature"), e.cast("double").alias("value"),
                              (F.lit(float(b)) * (e.cast("double") - F.lit(float(m)))).alias("impact"))
                     for (n, e), b, m in zip(columns.items(), coefficients, means)])


# ---------------------------------------------------------------- trees
def read_trees(model) -> list[tuple[float, list[dict]]]:
    """(weight, leaves) per tree of a fitted MLlib boosted model.

    A leaf is its value and, per feature on its path, the allowed interval and the share of training
    rows that passed this feature's splits.
    """
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        leaves: list[dict] = []
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, path = stack.pop()
            if node.subtreeDepth() == 0:
                leaves.append({"value": node.prediction(), "cover": float(node.impurityStats().rawCount()),
                               "path": path})
                continue
            split = node.split()
            f, cut, n = split.featureIndex(), split.threshold(), float(node.impurityStats().rawCount())
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
                part = float(child.impurityStats().rawCount()) / n if n else 0.0
                bound = (low, min(high, cut), share * part) if left else (max(low, cut), high, share * part)
                stack.append((child, {**path, f: bound}))
        out.append((weight, leaves))
    return out


def expected_value(trees: list[tuple[float, list[dict]]], scale: float = 1.0) -> float:
    """Score of a row about which nothing is known: leaf values weighted by training rows."""
    return scale * sum(w * sum(leaf["value"] * leaf["cover"] for leaf in leaves)
                       / sum(leaf["cover"] for leaf in leaves) for w, leaves in trees)


def shapley_values(x: np.ndarray, trees: list[tuple[float, list[dict]]], scale: float) -> np.ndarray:
    """Path-dependent Shapley values of every row and feature.

    For one leaf the game is a product: a feature in the coalition is 1 when the row passes its
    interval, one outside is the share of training rows that passed. The Shapley weights then act on
    the coefficients of a polynomial with as many factors as the leaf has features.
    """
    phi = np.zeros_like(x)
    for weight, leaves in trees:
        for leaf in leaves:
            feats = list(leaf["path"])
            m = len(feats)
            if m == 0:
                continue
            passes = [((x[:, f] > leaf["path"][f][0]) & (x[:, f] <= leaf["path"][f][1])).astype(float) for f in feats]
            shares = [leaf["path"][f][2] for f in feats]
            sizes = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
            for i, f in enumerate(feats):
                poly = [np.ones(len(x))]
                for j in range(m):
                    if j != i:  # multiply by (share + pass * z)
                        grown = [np.zeros(len(x)) for _ in range(len(poly) + 1)]
                        for s, c in enumerate(poly):
                            grown[s] += c * shares[j]
                            grown[s + 1] += c * passes[j]
                        poly = grown
                phi[:, f] += scale * weight * leaf["value"] * (passes[i] - shares[i]) * sum(
                    c * w for c, w in zip(poly, sizes))
    return phi


def tree_contributions(df: DataFrame, key: str, columns: dict[str, Column], model, scale: float = 2.0) -> DataFrame:
    """(id, feature, value, impact) of a boosted model; impacts plus expected_value give the log-odds.

    MLlib's boosted classifier turns its margin m into 1 / (1 + exp(-2 m)), hence scale 2.
    """
    names = list(columns)
    shared = df.sparkSession.sparkContext.broadcast(read_trees(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[[f"_x{i}" for i in range(len(names))]].to_numpy(float)
            phi = shapley_values(x, shared.value, scale)
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), len(names)), "feature": np.tile(names, len(b)),
                                "value": x.ravel(), "impact": phi.ravel()})
    rows = df.select(F.col(key).cast("long").alias("id"),
                     *[e.cast("double").alias(f"_x{i}") for i, e in enumerate(columns.values())])
    return rows.mapInPandas(run, "id long, feature string, value double, impact double")


# ---------------------------------------------------------------- reports
def feature_importance(long: DataFrame) -> DataFrame:
    """feature, importance = mean absolute impact."""
    return long.groupBy("feature").agg(F.avg(F.abs("impact")).alias("importance"))


def family_importance(long: DataFrame) -> DataFrame:
    """Impacts are added with their sign per (row, source table) before the absolute mean."""
    per_row = long.groupBy("id", family_of(F.col("feature")).alias("family")).agg(F.sum("impact").alias("impact"))
    per = per_row.groupBy("family").agg(F.avg(F.abs("impact")).alias("importance"))
    return per.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy(F.lit(0))))


def top_reasons(contributions: Column, k: int = 4) -> dict[str, Column]:
    """raises and lowers: the k largest impacts on each side, as arrays inside the row."""
    def side(sign: int) -> Column:
        kept = F.filter(contributions, lambda c: c["impact"] * sign > 0)
        keyed = F.transform(kept, lambda c: F.struct((-F.abs(c["impact"])).alias("o"), c["feature"].alias("feature"),
                                                     c["value"].alias("value"), c["impact"].alias("impact")))
        return F.slice(F.array_sort(keyed), 1, k)
    return {"raises": side(1), "lowers": side(-1)}


def reason_texts(reasons: Column) -> Column:
    """Sentences of the reasons that raise the risk."""
    return F.transform(reasons, lambda r: reason_sentence(feature_label(r["feature"]), format_value(r["value"])))


def rank_correlation(table: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two importance columns; the table has one row per feature."""
    everyone = Window.partitionBy(F.lit(0))

    def mean_rank(c: str) -> Column:
        first = F.rank().over(everyone.orderBy(c))
        return first + (F.count("*").over(Window.partitionBy(F.col(c))) - 1) / 2.0
    ranks = table.select(mean_rank(a).alias("ra"), mean_rank(b).alias("rb"))
    return ranks.agg(safe_corr(F.col("ra"), F.col("rb")).alias("rho"))


def permuted(df: DataFrame, key: str, column: str, repeat: int = 0, seed=42) -> DataFrame:
    """The rows with one column shuffled among them by seeded order."""
    from lendframe.operators.ranking import hash_rank
    here = hash_rank(df, key, seed=f"{seed}:{column}:{repeat}:a").drop("group_rows")
    there = (hash_rank(df.select(key, column), key, seed=f"{seed}:{column}:{repeat}:b")
             .select("hash_rank", F.col(column).alias("_moved")))
    return (here.join(there, on="hash_rank").withColumn(column, F.col("_moved"))
            .select(*df.columns))


def permutation_importance(fitted, df: DataFrame, key: str, label: str, columns: Sequence[str],
                           repeats: int = 3, seed=42) -> DataFrame:
    """feature, importance: mean AUC lost when the feature is shuffled."""
    from lendframe.operators.metrics import rank_metrics
    parts = None
    for c in columns:
        for r in range(repeats):
            scored = fitted.transform(permuted(df, key, c, r, seed)).select(
                F.lit(c).alias("feature"), F.lit(r).alias("repeat"), label, "p")
            parts = scored if parts is None else parts.unionByName(scored)
    drops = rank_metrics(parts, label, "p", by=["feature", "repeat"])
    base = rank_metrics(fitted.transform(df), label, "p").select(F.col("roc_auc").alias("base"))
    return (drops.transform(beside, base).groupBy("feature")
            .agg(F.avg(F.col("base") - F.col("roc_auc")).alias("importance")))


def individual_curves(fitted, df: DataFrame, key: str, column: str, values: Sequence[float]) -> DataFrame:
    """key, scores: one array a row, the score with the column set to each grid value. Rows are not repeated:
    the model is applied once for each value, in one pass."""
    stored, work = "_stored_value", df.withColumnRenamed(column, "_stored_value")
    names = [f"_score_{i}" for i in range(len(values))]
    for name, v in zip(names, values):
        work = fitted.transform(work.withColumn(column, F.lit(float(v)))).drop(column).withColumnRenamed("p", name)
    return work.withColumnRenamed(stored, column).select(key, F.array(*names).alias("scores"))


def partial_dependence(fitted, df: DataFrame, column: str, values: Sequence[float], key: str = "id") -> DataFrame:
    """grid_value, mean_p, n: the mean of all individual curves."""
    curves = individual_curves(fitted, df, key, column, values)
    sums = curves.agg(*[F.avg(F.col("scores")[i]).alias(f"m{i}") for i in range(len(values))], F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("grid_value"), F.col(f"m{i}").alias("mean_p")) for i, v in enumerate(values)]))
    return sums.select(each.alias("e"), "n").select("e.grid_value", "e.mean_p", "n")
