"""Cluster fits by MLlib and cluster measures as aggregates over array vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.hashing import seeded_hash
from lendframe.functions.nulls import sdiv
from lendframe.functions.text import feature_label
from lendframe.models.arrays import squared_distance
from lendframe.operators.metrics import rank_metrics
from lendframe.operators.joins import beside


def with_features(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(v).cast("array<double>")))


def kmeans(df: DataFrame, k: int, n_init: int = 4, max_iter: int = 300, tol: float = 1e-4, seed: int = 42):
    """Best of ``n_init`` seeded k-means|| starts by training cost."""
    best = None
    for i in range(n_init):
        model = KMeans(k=k, maxIter=max_iter, tol=tol, seed=seed + i, initMode="k-means||",
                       predictionCol="cluster").fit(df)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def _lloyd_pass(centres: dict[str, np.ndarray]):
    """Rows, sums of positions and squared distances of every cluster of every open model, in one pass."""
    def run(batches):
        from lendframe.models.joint_cv import named_rows
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                for name, c in centres.items():
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    near = d.argmin(1)
                    hit = np.zeros((len(x), len(c)))
                    hit[np.arange(len(x)), near] = 1
                    gap = ((x - c[near]) ** 2).sum(1)
                    one = np.concatenate([hit.sum(0), (hit.T @ x).ravel(), [gap.sum()]])
                    sums[name] = sums[name] + one if name in sums else one
        yield named_rows(list(sums), list(sums.values()))
    return run


def joint_kmeans(df: DataFrame, ks: Sequence[int], n_init: int = 4, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
                 key: str = "id", v: str = "v") -> dict[int, tuple[float, np.ndarray]]:
    """k -> (inertia, centres) of the best start. Lloyd steps of all k and starts share their passes over the rows.

    A start is the first k different rows in the order of a seeded hash. An empty cluster keeps its centre. A
    model is done when its centres move by no more than tol of the positions' mean variance. Without rows: no centres.
    """
    from lendframe.models.joint_cv import summed
    rows = df.select(key, F.col(v).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    centres: dict[str, np.ndarray] = {}
    for start in range(n_init):
        # twice the rows wanted, as some may be equal
        drawn = rows.orderBy(seeded_hash(F.col(key), f"{seed}:{start}")).limit(2 * max(ks)).collect()
        different = list(dict.fromkeys(tuple(r["v"]) for r in drawn))
        for k in ks:
            if len(different) >= k:
                centres[f"{k}|{start}"] = np.array(different[:k])
    found: dict[int, tuple[float, np.ndarray]] = {}
    rows, variance = rows.select("v").persist(StorageLevel.MEMORY_AND_DISK), None
    for step in range(max_iter + 1):
        if not centres:
            break
        sums, moved = summed(rows, _lloyd_pass(centres)), {}
        for name, c in centres.items():
            k, d = c.shape
            n, place, inertia = sums[name][:k], sums[name][k : k + k * d].reshape(k, d), sums[name][-1]
            new = np.where(n[:, None] > 0, place / np.maximum(n, 1)[:, None], c)
            if variance is None:
                variance = max(inertia / max(n.sum(), 1) / d, 1e-300)
            if step == max_iter or ((new - c) ** 2).sum() <= tol * variance:
                if k not in found or inertia < found[k][0]:
                    found[k] = (float(inertia), c)
            else:
                moved[name] = new
        centres = moved
    rows.unpersist()
    return found


def inertia_curve(df: DataFrame, ks: Sequence[int], n_init: int = 4, max_iter: int = 300, seed: int = 42) -> DataFrame:
    found = joint_kmeans(df, ks, n_init, max_iter, seed=seed)
    return df.sparkSession.createDataFrame([(k, found[k][0]) for k in sorted(found)], "k int, inertia double")


def gaussian_mixture(df: DataFrame, k: int, seed: int = 42, max_iter: int = 100):
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=1e-6, predictionCol="cluster").fit(df)


def bic(model, n: int, d: int) -> float:
    """-2 log-likelihood + parameters * ln(rows) of a full-covariance mixture."""
    k = model.getK()
    free = k - 1 + k * d + k * d * (d + 1) // 2
    return -2 * model.summary.logLikelihood + free * math.log(n)


def hierarchical(df: DataFrame, k: int, seed: int = 42):
    return BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(df)


def silhouette(df: DataFrame) -> float:
    """MLlib's silhouette, on squared Euclidean distances (the plain distance needs all pairs)."""
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(df)


def assign(df: DataFrame, centres: Sequence[Sequence[float]], v: str = "v") -> DataFrame:
    """Adds cluster (nearest centre, the first on ties) and its squared distance ``d2``."""
    options = F.array(*[F.struct(squared_distance(F.col(v), F.array(*[F.lit(float(x)) for x in c])).alias("d2"),
                                 F.lit(i).alias("cluster")) for i, c in enumerate(centres)])
    return df.withColumn("_n", F.array_min(options)).withColumns(
        {"cluster": F.col("_n.cluster"), "d2": F.col("_n.d2")}).drop("_n")


def lloyd_step(df: DataFrame, centres: Sequence[Sequence[float]], v: str = "v") -> DataFrame:
    """One assignment and mean step: cluster, n, inertia, centre."""
    d = len(centres[0])
    return (assign(df, centres, v).groupBy("cluster")
            .agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"),
                 *[F.avg(F.col(v)[i]).alias(f"_m{i}") for i in range(d)])
            .select("cluster", "n", "inertia", F.array(*[f"_m{i}" for i in range(d)]).alias("centre")))


def _centres(df: DataFrame, d: int, v: str) -> DataFrame:
    return (df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col(v)[i]).alias(f"_m{i}") for i in range(d)])
            .select("cluster", "n", F.array(*[f"_m{i}" for i in range(d)]).alias("centre")))


def separation(df: DataFrame, d: int, v: str = "v") -> DataFrame:
    """davies_bouldin and calinski_harabasz of labelled vectors.

    Two passes over the rows (centres, then distances); the rest works on one row per cluster.
    """
    centres = _centres(df, d, v)
    joined = df.join(F.broadcast(centres), on="cluster")  # one row per cluster
    sq = squared_distance(F.col(v).cast("array<double>"), F.col("centre"))
    spread = joined.groupBy("cluster").agg(F.avg(F.sqrt(sq)).alias("s"), F.sum(sq).alias("within"),
                                           F.max("n").alias("n"), F.first("centre").alias("centre"))
    listed = spread.agg(F.collect_list(F.struct("cluster", "s", "within", "n", "centre")).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    overall = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(
        F.col("c"), F.lit(0.0), lambda a, x: a + x["n"] * F.element_at(x["centre"], i.cast("int") + 1)) / total)
    worst = F.transform("c", lambda a: F.array_max(F.transform(
        F.filter("c", lambda b: b["cluster"] != a["cluster"]),
        lambda b: (a["s"] + b["s"]) / F.sqrt(squared_distance(a["centre"], b["centre"])))))
    k = F.size("c")
    within = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["within"])
    out = listed.withColumn("_all", overall)
    between = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"] * squared_distance(x["centre"], F.col("_all")))
    return out.select(
        (F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / k).alias("davies_bouldin"),
        sdiv(between / (k - 1), within / (total - k)).alias("calinski_harabasz"))


def _pairs(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2.0)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    n = F.col("n")
    both = cells.agg(_pairs(n).alias("together"), F.sum("n").alias("rows"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(_pairs(n).alias("in_a"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(_pairs(n).alias("in_b"))
    c = both.transform(beside, left).transform(beside, right)  # one row each
    chance = F.col("in_a") * F.col("in_b") / (F.col("rows") * (F.col("rows") - 1) / 2.0)
    return c.select(F.coalesce(sdiv(F.col("together") - chance, (F.col("in_a") + F.col("in_b")) / 2.0 - chance),
                               F.lit(1.0)).alias("ari"))


def cluster_rates(df: DataFrame, y: str, cluster: str = "cluster", min_rows: int = 50, noise: int = -1) -> DataFrame:
    """Lowest and highest label rate over clusters of enough rows, and the AUC of "my cluster's rate"."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(y).alias("rate"))
    ends = per.where((F.col(cluster) != noise) & (F.col("n") >= min_rows)).agg(
        F.min("rate").alias("lowest"), F.max("rate").alias("highest"))
    auc = rank_metrics(df.join(per, on=cluster), y, "rate").select("roc_auc")
    return ends.transform(beside, auc)


def segment_profile(df: DataFrame, fields: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Share of rows and mean of each field per cluster."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in fields])
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def personas(long: DataFrame, clusters: DataFrame, y: str, top: int = 3) -> DataFrame:
    """Per cluster: rows, label rate and its largest mean impacts as text.

    ``long`` has id, feature, impact; ``clusters`` has id, cluster and the label. Both have a row for every id,
    so they are joined by sorting: adaptive execution would broadcast them over the driver.
    """
    mean = (long.join(clusters.select("id", "cluster").hint("merge"), on="id").groupBy("cluster", "feature")
            .agg(F.avg("impact").alias("impact")))
    w = Window.partitionBy("cluster").orderBy(F.desc("impact"), "feature")
    named = mean.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).withColumn(
        "text", F.concat(feature_label(F.col("feature")), F.format_string(" (%+.2f)", "impact")))
    words = named.groupBy("cluster").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "; ").alias("reasons"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(y).alias("rate"))
    return sizes.join(words, on="cluster")
