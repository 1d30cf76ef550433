"""Evaluation metrics, bootstraps and significance tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lendframe.operators import bootstrap, stats_tests
from lendframe.operators import metrics as m
from lendframe.plans.adapters import view
from lendframe.queries.registry import add
from lendframe.functions.hashing import POISSON1
from lendframe.operators.joins import beside


def lines(s, d):
    return view(s, d, "line_scores")


def scores(s, d):
    return view(s, d, "scores")


CURVE = """
cells AS (SELECT p AS score, sum(y) AS pos, count(*) - sum(y) AS neg FROM line_scores GROUP BY 1),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM cells WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
RANKS = """CAST(sum(pos * (nn - fp + neg / 2e0)) AS DOUBLE) / (max(np) * CAST(max(nn) AS DOUBLE)) AS roc_auc,
  sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(np) AS pr_auc,
  greatest(max(CAST(tp AS DOUBLE) / np - CAST(fp AS DOUBLE) / nn), 0) AS ks"""
add("ev_1_auc_gini", "d6:roc_auc,gini", lambda s, d: m.rank_metrics(lines(s, d), "y", "p"),
    f"SELECT roc_auc, 2 * roc_auc - 1 AS gini FROM (SELECT {RANKS} FROM curve)", ["line_scores"], CURVE)
add("ev_2_average_precision", "d6:pr_auc", lambda s, d: m.rank_metrics(lines(s, d), "y", "p"),
    f"SELECT {RANKS} FROM curve", ["line_scores"], CURVE)
add("ev_3_ks", "d6:ks", lambda s, d: m.rank_metrics(lines(s, d), "y", "p"),
    f"SELECT {RANKS} FROM curve", ["line_scores"], CURVE)
add("win_4_cumulative_rates", "d6:score,tpr,fpr", lambda s, d: m.curve_points(scores(s, d), "y", "p"),
    """SELECT score, CAST(tp AS DOUBLE) / np AS tpr, CAST(fp AS DOUBLE) / nn AS fpr FROM curve""",
    ["scores"], CURVE.replace("line_scores", "scores"))
add("win_5_precision_recall", "d6:score,tpr,precision", lambda s, d: m.curve_points(scores(s, d), "y", "p"),
    """SELECT score, CAST(tp AS DOUBLE) / np AS tpr, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM curve""",
    ["scores"], CURVE.replace("line_scores", "scores"))
add("ev_14_curve_points", "d6:score,tpr,fpr,precision", lambda s, d: m.curve_points(lines(s, d), "y", "p"),
    """SELECT score, CAST(tp AS DOUBLE) / np AS tpr, CAST(fp AS DOUBLE) / nn AS fpr,
       CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM curve""", ["line_scores"], CURVE)

PROB = """avg((p - y) * (p - y)) AS brier,
  -avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-15), 1 - 1e-15))
       ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END) AS log_loss,
  count(*) AS n, avg(y) AS default_rate"""
add("ev_4_brier_log_loss", "d6:brier,log_loss,default_rate i:n",
    lambda s, d: m.probability_metrics(lines(s, d), "y", "p"), f"SELECT {PROB} FROM line_scores",
    ["line_scores"])


def uniform_bin_sql(p: str, n: int) -> str:
    return " + ".join(f"CASE WHEN {p} >= {i * (1.0 / n)!r}e0 THEN 1 ELSE 0 END" for i in range(1, n))


UNI = f"""bins AS (SELECT grp, {uniform_bin_sql('p', 10)} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my
  FROM line_scores GROUP BY 1, 2)"""
add("ev_5_ece_uniform", "d6:ece s:grp", lambda s, d: m.calibration_error(lines(s, d), "y", "p", by=["grp"]),
    "SELECT grp, sum(n * abs(my - mp)) / sum(n) AS ece FROM bins GROUP BY 1", ["line_scores"], UNI)
_Q = ", ".join(f"{i / 10}e0" for i in range(11))
QUA = f"""q AS (SELECT quantile_cont(p, [{_Q}]) AS e FROM line_scores),
bins AS (SELECT CAST(len(list_filter(list_distinct(e[2:10]), lambda x: x <= p AND x > e[1])) AS INT) AS bin, count(*) AS n,
  avg(p) AS mp, avg(y) AS my FROM line_scores, q GROUP BY 1)"""
add("ev_5_ece_quantile", "d6:ece", lambda s, d: m.calibration_error(lines(s, d), "y", "p", 10, "quantile"),
    "SELECT sum(n * abs(my - mp)) / sum(n) AS ece FROM bins", ["line_scores"], QUA)
add("ev_6_at_threshold", "i:tp,fp,fn,tn d6:threshold,precision,recall,f1,accuracy,approval_rate",
    lambda s, d: m.at_threshold(lines(s, d), "y", "p", 0.45),
    """SELECT *, 0.45e0 AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
       2e0 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
       (fn + tn) / (tp + fp + fn + tn)::DOUBLE AS approval_rate
       FROM (SELECT count(*) FILTER (p >= 0.45e0 AND y = 1) AS tp, count(*) FILTER (p >= 0.45e0 AND y = 0) AS fp,
       count(*) FILTER (p < 0.45e0 AND y = 1) AS fn, count(*) FILTER (p < 0.45e0 AND y = 0) AS tn FROM line_scores)""",
    ["line_scores"])
add("ev_7_evaluate", "s:grp i:n d6:roc_auc,gini,pr_auc,ks,brier,log_loss,ece,default_rate",
    lambda s, d: m.evaluate(lines(s, d), "y", "p", by=["grp"]),
    f"""SELECT grp, roc_auc, 2 * roc_auc - 1 AS gini, pr_auc, ks, brier, log_loss, n, default_rate, ece
        FROM (SELECT grp, {RANKS} FROM curve GROUP BY 1)
        JOIN (SELECT grp, {PROB} FROM line_scores GROUP BY 1) USING (grp)
        JOIN (SELECT grp, sum(n * abs(my - mp)) / sum(n) AS ece FROM bins GROUP BY 1) USING (grp)""",
    ["line_scores"], UNI + """,
cells AS (SELECT grp, p AS score, sum(y) AS pos, count(*) - sum(y) AS neg FROM line_scores GROUP BY 1, 2),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS np,
  sum(neg) OVER (PARTITION BY grp) AS nn
  FROM cells WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""")


def _fold_summary(s, d):
    """Fold mean and sample deviation of the metrics, best model first."""
    rows = scores(s, d).withColumn("fold", F.col("id") % 5)
    out = None
    for model in ("p", "p2"):
        folds = m.rank_metrics(rows, "y", model, by=["fold"])
        one = folds.agg(F.avg("roc_auc").alias("auc_mean"), F.stddev_samp("roc_auc").alias("auc_std"),
                        F.avg("ks").alias("ks_mean")).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("auc_mean"))


_FOLDS = " UNION ALL ".join(f"""SELECT '{x}' AS model, id % 5 AS fold, {x} AS score, sum(y) AS pos,
  count(*) - sum(y) AS neg FROM scores GROUP BY 1, 2, 3""" for x in ("p", "p2"))
add("ev_7_results_table", "s:model d6:auc_mean,auc_std,ks_mean", _fold_summary,
    f"""SELECT model, avg(roc_auc) AS auc_mean, stddev_samp(roc_auc) AS auc_std, avg(ks) AS ks_mean FROM (
        SELECT model, fold, {RANKS} FROM curve GROUP BY 1, 2) GROUP BY 1""", ["scores"], f"""
cells AS ({_FOLDS}),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, fold) AS np,
  sum(neg) OVER (PARTITION BY model, fold) AS nn
  FROM cells WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""")

_INNER = ", ".join(f"{i / 10}e0" for i in range(1, 10))
add("ev_13_reliability", "s:grp i:bin,n d6:mean_p,rate",
    lambda s, d: m.reliability_curve(lines(s, d), "y", "p", by=["grp"]),
    """SELECT grp, len(list_filter(e, lambda x: x < p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate
       FROM line_scores JOIN q USING (grp) GROUP BY 1, 2""", ["line_scores"],
    f"q AS (SELECT grp, quantile_cont(p, [{_INNER}]) AS e FROM line_scores GROUP BY 1)")
add("ev_17_score_histogram", "s:grp i:bin,n", lambda s, d: m.score_histogram(lines(s, d), "p", by=["grp"]),
    f"SELECT grp, {uniform_bin_sql('p', 20)} AS bin, count(*) AS n FROM line_scores GROUP BY 1, 2",
    ["line_scores"])

# ---------------------------------------------------------------- bootstrap
N_BOOT = 1000


def _mix_sql(x: str, inside: str) -> str:
    """Adds the scrambled 32-bit number of column x to a sub-query, step by step."""
    def times(c: str, factor: int, shift: int, sub: str) -> str:
        return f"SELECT * REPLACE ((xor({c}, {c} >> {shift}) * {factor}) % 4294967296 AS {c}) FROM ({sub})"
    return f"SELECT * REPLACE (xor({x}, {x} >> 16) AS {x}) FROM ({times(x, 0xC2B2AE35, 13, times(x, 0x85EBCA6B, 16, inside))})"


def reps_sql(seed=42) -> str:
    h = f"md5(concat(CAST(id AS VARCHAR), ':{seed}'))"
    first = f"""SELECT id, y, p, p2, rep, CAST(CAST('0x' || substr({h}, 9, 8) AS BIGINT) AS UBIGINT) AS h1,
      CAST((CAST('0x' || substr({h}, 1, 8) AS BIGINT) + rep * {bootstrap.GOLDEN}) % 4294967296 AS UBIGINT) AS u
      FROM scores, range(1, {N_BOOT + 1}) r(rep)"""
    drawn = _mix_sql("u", f"SELECT * REPLACE (xor(u, h1) AS u) FROM ({_mix_sql('u', first)})")
    weight = " + ".join(f"CAST(u >= {int(c)} AS INT)" for c in bootstrap.STEPS)
    return f"reps AS (SELECT * FROM (SELECT id, y, p, p2, rep, {weight} AS w FROM ({drawn})) WHERE w > 0)"


def auc_sql(score: str, table: str, rep: str = "rep", weight: str = "w") -> str:
    return f"""(SELECT {rep} AS rep, CAST(sum(pos * (nn - fp + neg / 2e0)) AS DOUBLE) / (max(np) * CAST(max(nn) AS DOUBLE)) AS v FROM (
      SELECT *, sum(neg) OVER (PARTITION BY {rep} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
        sum(pos) OVER (PARTITION BY {rep}) AS np, sum(neg) OVER (PARTITION BY {rep}) AS nn FROM (
        SELECT {rep}, {score} AS s, sum({weight} * y) AS pos, sum({weight} * (1 - y)) AS neg FROM {table} GROUP BY 1, 2)) GROUP BY 1)"""


add("ev_8_bootstrap_auc", "d6:estimate,low,high i:n_boot",
    lambda s, d: bootstrap.bootstrap_ci(scores(s, d), "id", "y", "p", n_boot=N_BOOT),
    f"""SELECT (SELECT max(v) FROM {auc_sql('p', '(SELECT *, 0 AS rep, 1 AS w FROM scores)')}) AS estimate,
        quantile_cont(v, {(1 - 0.95) / 2!r}e0) AS low, quantile_cont(v, {1 - (1 - 0.95) / 2!r}e0) AS high,
        count(*) AS n_boot FROM {auc_sql('p', 'reps')}""", ["scores"], reps_sql())
add("spl_6_bootstrap_resamples", "i:rep,rows,total",
    lambda s, d: bootstrap.replicate_totals(scores(s, d), "id", n_boot=N_BOOT).where("rep > 0"),
    "SELECT rep, count(*) AS rows, sum(w) AS total FROM reps GROUP BY 1", ["scores"], reps_sql())
PAIRED = f"""diffs AS (SELECT a.v - b.v AS d FROM {auc_sql('p', 'reps')} a JOIN {auc_sql('p2', 'reps')} b USING (rep))"""
add("ev_9_paired_bootstrap", "d6:difference,low,high,p_value i:significant",
    lambda s, d: bootstrap.paired_bootstrap(scores(s, d), "id", "y", "p", "p2", n_boot=N_BOOT),
    f"""SELECT *, CASE WHEN low > 0 OR high < 0 THEN 1 ELSE 0 END AS significant FROM (
        SELECT (SELECT max(v) FROM {auc_sql('p', '(SELECT *, 0 AS rep, 1 AS w FROM scores)')})
          - (SELECT max(v) FROM {auc_sql('p2', '(SELECT *, 0 AS rep, 1 AS w FROM scores)')}) AS difference,
        quantile_cont(d, {(1 - 0.95) / 2!r}e0) AS low, quantile_cont(d, {1 - (1 - 0.95) / 2!r}e0) AS high,
        least(1e0, 2 * least(avg(CASE WHEN d <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN d >= 0 THEN 1e0 ELSE 0e0 END))) AS p_value
        FROM diffs)""", ["scores"], reps_sql() + ", " + PAIRED)
add("cal_3_choose_calibrator", "d6:difference,low,high s:chosen",
    lambda s, d: bootstrap.better_calibrator(scores(s, d), "id", "y", "p2", "p", n_boot=N_BOOT),
    f"""SELECT *, CASE WHEN high < 0 THEN 'p' ELSE 'none' END AS chosen FROM (
        SELECT (SELECT avg(pow(p - y, 2)) - avg(pow(p2 - y, 2)) FROM scores) AS difference,
        quantile_cont(d, {(1 - 0.95) / 2!r}e0) AS low, quantile_cont(d, {1 - (1 - 0.95) / 2!r}e0) AS high
        FROM (SELECT rep, sum(w * pow(p - y, 2)) / sum(w) - sum(w * pow(p2 - y, 2)) / sum(w) AS d
          FROM reps GROUP BY 1))""", ["scores"], reps_sql())

# ---------------------------------------------------------------- tests


def _mcnemar(s, d):
    rows = scores(s, d).select(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int").alias("a"),
                               ((F.col("p2") >= 0.5).cast("int") == F.col("y")).cast("int").alias("b"))
    return stats_tests.mcnemar(rows, "a", "b")


add("ev_10_mcnemar", "i:only_a_right,only_b_right d6:p_value", _mcnemar)


def _group_p_values(s, d):
    """Per group a z-like value turned into a p-value stand-in, then Holm within score kind."""
    g = scores(s, d).groupBy("grp", "sex").agg(F.avg(F.abs(F.col("p") - F.col("p2"))).alias("pv"))
    return stats_tests.holm(g.withColumn("pv", F.col("pv") / 10), "pv", family=["sex"])


add("win_7_holm", "s:grp,sex d6:pv,adjusted", _group_p_values,
    """SELECT grp, sex, pv, least(1e0, max(step) OVER (PARTITION BY sex ORDER BY pv ROWS UNBOUNDED PRECEDING)) AS adjusted
       FROM (SELECT *, (count(*) OVER (PARTITION BY sex) - row_number() OVER (PARTITION BY sex ORDER BY pv) + 1) * pv AS step
       FROM (SELECT grp, sex, avg(abs(p - p2)) / 10 AS pv FROM scores GROUP BY 1, 2))""", ["scores"])


def _blend(s, d):
    rows = scores(s, d).withColumn("blend", (F.col("p") + F.col("p2")) / 2)
    auc = m.rank_metrics(rows, "y", "blend").select("roc_auc")
    return auc.transform(beside, rows.agg(F.corr("p", "p2").alias("correlation")))


add("md_19_blend", "d6:roc_auc,correlation", _blend,
    f"""SELECT (SELECT max(v) FROM {auc_sql('(p + p2) / 2', '(SELECT *, 0 AS rep, 1 AS w FROM scores)')}) AS roc_auc,
        corr(p, p2) AS correlation FROM scores""", ["scores"])
add("win_3_running_best", "i:trial d6:auc,best_so_far", lambda s, d: _running_best(s, d),
    f"""SELECT rep AS trial, v AS auc, max(v) OVER (ORDER BY rep ROWS UNBOUNDED PRECEDING) AS best_so_far
        FROM {auc_sql('p', '(SELECT *, cust % 20 AS rep, 1 AS w FROM scores)')}""", ["scores"])


def _running_best(s, d):
    """AUC of 20 trials (one per residue of the customer key) and the best so far."""
    trials = m.rank_metrics(scores(s, d).withColumn("trial", F.col("cust") % 20), "y", "p", by=["trial"])
    order = Window.partitionBy(F.lit(0)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.select("trial", F.col("roc_auc").alias("auc"),
                         F.max("roc_auc").over(order).alias("best_so_far"))
