"""Clusters, mixtures and personas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.models import moments
from lendframe.operators import clusters
from lendframe.operators.metrics import rank_metrics
from lendframe.plans.adapters import view
from lendframe.queries.explaining import long
from lendframe.queries.modelling import DIMS, _wide, vectors
from lendframe.queries.registry import add
from lendframe.operators.joins import beside


def points(s, d):
    return clusters.with_features(vectors(s, d).select("id", "label", F.slice("v", 1, DIMS).alias("v")))


CENTRES = [[0.1 * ((i + j) % 3 - 1) for j in range(DIMS)] for i in range(4)]
_EMB = f"emb AS (SELECT vec_id AS id, label, list_transform(embedding[1:{DIMS}], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _d2(c) -> str:
    return " + ".join(f"pow(v[{j + 1}] - {x!r}e0, 2)" for j, x in enumerate(c))


_NEAR = f"""near AS (SELECT *, least({', '.join(_d2(c) for c in CENTRES)}) AS d2, CASE {' '.join(
    f"WHEN {_d2(c)} = least({', '.join(_d2(x) for x in CENTRES)}) THEN {i}" for i, c in enumerate(CENTRES))} END AS cluster FROM emb)"""
add("un_2_lloyd_step", "i:cluster,n d:inertia,c0,c7",
    lambda s, d: clusters.lloyd_step(points(s, d), CENTRES).select(
        "cluster", "n", "inertia", F.col("centre")[0].alias("c0"), F.col("centre")[7].alias("c7")),
    "SELECT cluster, count(*) AS n, sum(d2) AS inertia, avg(v[1]) AS c0, avg(v[8]) AS c7 FROM near GROUP BY 1", (),
    _EMB + ", " + _NEAR)


def _kmeans(s, d):
    model = clusters.kmeans(points(s, d), 4, n_init=2, max_iter=50)
    return model.transform(points(s, d)).groupBy("cluster").agg(F.count("*").alias("n"))


add("un_1_kmeans", "i:cluster,n", _kmeans)


def _curve_checks(s, d):
    """Nine sums of squares: none above the spread around one centre, none below zero, one Lloyd step makes none worse."""
    rows = points(s, d)
    found, one = clusters.joint_kmeans(rows, range(1, 11)), []
    for k in range(2, 11):
        after = clusters.lloyd_step(rows, found[k][1].tolist()).agg(F.sum("n").alias("n"), F.sum("inertia").alias("i")).first()
        one.append((k, after["n"], int(abs(after["i"] - found[k][0]) < 1e-6 * found[k][0]), int(0 < found[k][0] <= found[1][0])))
    return s.createDataFrame(one, "k int, n long, same int, inside int")


add("un_1_curve_checks", "i:k,n,same,inside", _curve_checks,
    "SELECT k, count(*) AS n, 1 AS same, 1 AS inside FROM embeddings, range(2, 11) t(k) GROUP BY 1")
add("un_1_inertia_curve", "i:k d:inertia", lambda s, d: clusters.inertia_curve(points(s, d), range(2, 11)))


def _mixture(s, d):
    rows = points(s, d).persist()
    n = rows.count()
    out = []
    for k in (2, 3):
        model = clusters.gaussian_mixture(rows, k)
        out.append((k, float(model.summary.logLikelihood), clusters.bic(model, n, DIMS)))
    return s.createDataFrame(out, "k int, log_likelihood double, bic double")


add("un_3_gaussian_mixture", "i:k d:log_likelihood,bic", _mixture)


def _silhouette(s, d):
    rows = points(s, d)
    value = clusters.silhouette(clusters.assign(rows, CENTRES))
    return rows.agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(value))


add("un_4_silhouette", "i:n d:silhouette", _silhouette)
_CEN = ", ".join(f"avg(v[{j + 1}]) AS m{j}" for j in range(DIMS))
_DIST = " + ".join(f"pow(v[{j + 1}] - m{j}, 2)" for j in range(DIMS))
_BETWEEN = " + ".join(f"pow(a.m{j} - b.m{j}, 2)" for j in range(DIMS))
_TOTAL = " + ".join(f"pow(m{j} - g{j}, 2)" for j in range(DIMS))
add("un_5_separation", "d6:davies_bouldin,calinski_harabasz",
    lambda s, d: clusters.separation(points(s, d).withColumn("cluster", F.col("label")), DIMS),
    f"""SELECT (SELECT avg(w) FROM (SELECT a.label, max((a.s + b.s) / sqrt({_BETWEEN})) AS w FROM stats a JOIN stats b ON a.label <> b.label GROUP BY 1)) AS davies_bouldin,
        (SELECT (sum(n * ({_TOTAL})) / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))) FROM stats, everyone) AS calinski_harabasz""", (),
    _EMB + f""", cen AS (SELECT label, count(*) AS n, {_CEN} FROM emb GROUP BY 1),
everyone AS (SELECT {', '.join(f'avg(v[{j + 1}]) AS g{j}' for j in range(DIMS))} FROM emb),
stats AS (SELECT label, max(n) AS n, {', '.join(f'max(m{j}) AS m{j}' for j in range(DIMS))}, avg(sqrt({_DIST})) AS s, sum({_DIST}) AS within
  FROM emb JOIN cen USING (label) GROUP BY 1)""")
add("un_6_adjusted_rand", "d6:ari",
    lambda s, d: clusters.adjusted_rand(clusters.assign(points(s, d), CENTRES), "label", "cluster"),
    """SELECT (t - e) / ((a + b) / 2 - e) AS ari FROM (SELECT t, a, b, a * b / (n * (n - 1) / 2e0) AS e FROM
       (SELECT sum(c * (c - 1) / 2e0) AS t, sum(c) AS n FROM (SELECT count(*) AS c FROM near GROUP BY label, cluster)),
       (SELECT sum(c * (c - 1) / 2e0) AS a FROM (SELECT count(*) AS c FROM near GROUP BY label)),
       (SELECT sum(c * (c - 1) / 2e0) AS b FROM (SELECT count(*) AS c FROM near GROUP BY cluster)))""", (), _EMB + ", " + _NEAR)


def _rates(s, d):
    rows = view(s, d, "scores").withColumn("cluster", (F.col("cust") % 7 - 1).cast("int"))
    return clusters.cluster_rates(rows, "y")


add("un_7_cluster_rates", "d6:lowest,highest,roc_auc", _rates,
    """SELECT lowest, highest, roc_auc FROM (SELECT min(rate) FILTER (g <> -1 AND n >= 50) AS lowest, max(rate) FILTER (g <> -1 AND n >= 50) AS highest FROM per),
       (SELECT sum(bad * (below + (n - bad) / 2e0)) / (sum(bad) * CAST(sum(n - bad) AS DOUBLE)) AS roc_auc FROM (
         SELECT bad, n, sum(n - bad) OVER (ORDER BY rate ROWS UNBOUNDED PRECEDING) - (n - bad) AS below FROM (
           SELECT rate, sum(bad) AS bad, sum(n) AS n FROM per GROUP BY 1)))""", ["scores"],
    "per AS (SELECT cust % 7 - 1 AS g, count(*) AS n, sum(y) AS bad, avg(y) AS rate FROM scores GROUP BY 1)")
add("un_8_segment_profile", "i:cluster,n d:share,age,amount",
    lambda s, d: clusters.segment_profile(view(s, d, "scores").withColumn("cluster", F.col("cust") % 5), ["age", "amount"]),
    """SELECT cust % 5 AS cluster, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM scores) AS share, avg(age) AS age, avg(amount) AS amount
       FROM scores GROUP BY 1""", ["scores"])


def _personas(s, d):
    """Declined applicants grouped by why they were declined."""
    impacts = long(s, d)
    wide = impacts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feature", "impact"))).alias("c")).select(
        "id", F.transform("c", lambda x: x["impact"]).alias("v"), F.aggregate("c", F.lit(-1.2), lambda a, x: a + x["impact"]).alias("z"))
    risky = clusters.with_features(wide.where("z > -1").select("id", "v"))
    grouped = clusters.kmeans(risky, 3, n_init=1, max_iter=30).transform(risky).select("id", "cluster")
    labels = view(s, d, "application").select(F.col("SK_ID_CURR").alias("id"), F.col("TARGET").alias("y"))
    labelled = grouped.join(labels.hint("merge"), on="id")  # rows by applicant, too many to go over the driver
    return clusters.personas(impacts, labelled, "y")


add("un_9_personas", "i:cluster,n d:rate s:reasons", _personas)


def _scree(s, d):
    """Share of each principal component and the AUC of the direction that separates two label groups."""
    cols = [f"v{i}" for i in range(DIMS)]
    rows = _wide(s, d).withColumn("y", (F.col("label") < 5).cast("int"))
    pca = moments.fit_pca(rows, cols)
    lda = moments.fit_lda(rows, cols, "y")
    auc = rank_metrics(rows.withColumn("d", next(iter(moments.lda_columns(lda).values()))), "y", "d").select("roc_auc")
    table = s.createDataFrame([(i + 1, float(x), float(sum(pca["share"][:i + 1]))) for i, x in enumerate(pca["share"])],
                              "component int, share double, cumulative double")
    return table.transform(beside, auc)


add("un_10_scree_and_direction", "i:component d6:share,cumulative,roc_auc", _scree)


def _explained(s, d):
    from pyspark.sql import Window
    order = Window.partitionBy(F.lit(0)).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    table = _scree(s, d).withColumn("so_far", F.sum("share").over(order))
    return table.where("so_far >= 0.9").agg(F.min("component").alias("needed"))


add("win_8_explained_variance", "i:needed", _explained)
add("un_11_hierarchical", "i:cluster,n", lambda s, d: clusters.hierarchical(points(s, d), 4).transform(points(s, d)).groupBy(
    "cluster").agg(F.count("*").alias("n")))
