"""Fairness audit and mitigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.functions.bins import age_band
from lendframe.operators import fairness, splits
from lendframe.plans.adapters import view
from lendframe.queries.decisions import (BREAK_EVEN, CUTS, DECIDE, GAIN, LGD, MARGIN, RATES, rates_sql,
                                         values, with_cuts)
from lendframe.queries.registry import add
from lendframe.queries.sampling import hash_sql, hex_sql

LIMIT = 0.45  # decision threshold of the audit: the made scores are high
BAND = """CASE WHEN age >= 60 THEN '60+' WHEN age >= 45 THEN '45-60' WHEN age >= 30 THEN '30-45'
  WHEN age >= 0 THEN '<30' END"""


def rows(s, d):
    return view(s, d, "scores").withColumns({
        "band": age_band(F.col("age")), "approved": (F.col("p") < LIMIT).cast("int")})


LONG = f"""
base AS (SELECT *, {BAND} AS band, CASE WHEN p < {LIMIT}e0 THEN 1 ELSE 0 END AS approved FROM scores),
long AS (SELECT 'sex' AS attribute, sex AS "group", y, p, approved FROM base
  UNION ALL SELECT 'band', band, y, p, approved FROM base),
cells AS (SELECT attribute, "group", p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM long GROUP BY 1, 2, 3),
aucs AS (SELECT attribute, "group", CAST(sum(pos * (nn - fp + neg / 2e0)) AS DOUBLE) / (max(np) * CAST(max(nn) AS DOUBLE)) AS roc_auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY attribute, "group" ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
    sum(pos) OVER (PARTITION BY attribute, "group") AS np, sum(neg) OVER (PARTITION BY attribute, "group") AS nn
    FROM cells) GROUP BY 1, 2),
audit AS (SELECT attribute, "group", count(*) AS applicants, avg(y) AS default_rate, avg(p) AS mean_predicted,
  avg(approved) AS approval_rate, 1 - avg(CASE WHEN y = 0 THEN approved END) AS good_declined,
  1 - avg(CASE WHEN y = 1 THEN approved END) AS defaulters_declined, max(roc_auc) AS roc_auc
  FROM long JOIN aucs USING (attribute, "group") GROUP BY 1, 2)"""
AUDIT_SPEC = ("s:attribute,group i:applicants d6:default_rate,mean_predicted,roc_auc,approval_rate,"
              "good_declined,defaulters_declined")


def _audit(s, d):
    return fairness.audit(rows(s, d), "y", "p", "approved", ["sex", "band"])


add("fa_1_audit", AUDIT_SPEC, _audit, "SELECT * FROM audit", ["scores"], LONG)
add("fa_2_gaps", "s:attribute d6:parity_difference,opportunity_gap,odds_difference,impact_ratio",
    lambda s, d: fairness.gaps(_audit(s, d)),
    """SELECT attribute, max(approval_rate) - min(approval_rate) AS parity_difference,
       max(good_declined) - min(good_declined) AS opportunity_gap,
       greatest(max(good_declined) - min(good_declined), max(defaulters_declined) - min(defaulters_declined)) AS odds_difference,
       min(approval_rate) / nullif(max(approval_rate), 0) AS impact_ratio FROM audit GROUP BY 1""", ["scores"], LONG)


def _conformal_groups(s, d):
    return fairness.conformal_by_group(with_cuts(s, d).withColumn("band", age_band(F.col("age"))),
                                       "y", "p", ["sex", "band"])


CONF_GROUPS = f"""
judged AS (SELECT *, {DECIDE} AS d, {BAND} AS band FROM scores, cuts WHERE part = 'valid'),
conf_groups AS (SELECT attribute, "group", {rates_sql()} FROM (
  SELECT 'sex' AS attribute, sex AS "group", * FROM judged UNION ALL SELECT 'band', band, * FROM judged) GROUP BY 1, 2)"""
add("fa_3_conformal_by_group", "s:attribute,group " + RATES, _conformal_groups,
    "SELECT * FROM conf_groups", ["scores"], CUTS + "," + CONF_GROUPS)
add("jn_10_stitched_audit", AUDIT_SPEC + " " + RATES.replace("good_declined", "good_auto_declined"),
    lambda s, d: _audit(s, d).join(
        _conformal_groups(s, d).withColumnRenamed("good_declined", "good_auto_declined"),
        on=["attribute", "group"]),
    """SELECT * FROM audit JOIN (SELECT * RENAME (good_declined AS good_auto_declined) FROM conf_groups)
       USING (attribute, "group")""", ["scores"],
    LONG + "," + CUTS + "," + CONF_GROUPS)
add("fa_4_reweighing", "i:id d6:weight", lambda s, d: fairness.reweighing(rows(s, d), "y", "sex"),
    """SELECT id, CAST(count(*) OVER (PARTITION BY sex) AS DOUBLE) * count(*) OVER (PARTITION BY y)
       / (count(*) OVER () * CAST(count(*) OVER (PARTITION BY sex, y) AS DOUBLE)) AS weight FROM scores""", ["scores"])

_G = values(fairness.GRID, "threshold")


def thresholds_sql(table: str, max_gap: float, part: str = "0") -> str:
    """Brute force over all pairs of thresholds for the two groups."""
    return f"""(SELECT part, f.threshold AS tf, m.threshold AS tm, f.profit + m.profit AS total,
      row_number() OVER (PARTITION BY part ORDER BY round(f.profit + m.profit, 6) DESC, f.threshold, m.threshold) AS r
      FROM (SELECT * FROM {table} WHERE g = 'F') f JOIN (SELECT * FROM {table} WHERE g = 'M') m USING (part)
      WHERE greatest(f.declined, m.declined) - least(f.declined, m.declined) <= {max_gap}e0)"""


OPTIONS = f"""options AS (SELECT 0 AS part, sex AS g, threshold, sum(CASE WHEN p < threshold THEN {GAIN} ELSE 0 END) AS profit,
  1 - CAST(sum(CASE WHEN y = 0 AND p < threshold THEN 1 ELSE 0 END) AS DOUBLE) / sum(1 - y) AS declined
  FROM scores, {_G} GROUP BY 1, 2, 3)"""
add("fa_5_group_thresholds", "s:group d:threshold d2:total",
    lambda s, d: fairness.group_thresholds(rows(s, d), "y", "p", "sex", "amount", MARGIN, LGD, 0.01),
    f"""SELECT 'F' AS "group", tf AS threshold, total FROM {thresholds_sql('options', 0.01)} WHERE r = 1
        UNION ALL SELECT 'M', tm, total FROM {thresholds_sql('options', 0.01)} WHERE r = 1""", ["scores"], OPTIONS)
MAX_GAPS = [1.0, 0.02, 0.005]
FOLD = f"{hex_sql(hash_sql('id', 42))} % 5"
FOLD_OPTIONS = f"""folded AS (SELECT sex, y, p, amount, {FOLD} AS fold FROM scores),
options AS (SELECT f.part, sex AS g, threshold, sum(CASE WHEN p < threshold THEN {GAIN} ELSE 0 END) AS profit,
  1 - CAST(sum(CASE WHEN y = 0 AND p < threshold THEN 1 ELSE 0 END) AS DOUBLE) / sum(1 - y) AS declined
  FROM folded JOIN range(0, 5) f(part) ON fold <> part, {_G} GROUP BY 1, 2, 3)"""
add("fa_6_crossfit_thresholds", "d:max_gap,threshold i:part s:group",
    lambda s, d: fairness.crossfit_group_thresholds(
        rows(s, d).withColumn("fold", splits.hash_fold("id", 5)), "y", "p", "sex", "amount", "fold",
        MARGIN, LGD, MAX_GAPS),
    " UNION ALL ".join(f"""SELECT {g}e0 AS max_gap, part, unnest(['F', 'M']) AS "group", unnest([tf, tm]) AS threshold
        FROM {thresholds_sql('options', g)} WHERE r = 1""" for g in MAX_GAPS), ["scores"], FOLD_OPTIONS)
add("fa_8_impossibility", "s:sex d6:base_rate,ppv,tpr,fpr,miss_rate,fpr_from_identity",
    lambda s, d: fairness.impossibility(rows(s, d).withColumn("declined", 1 - F.col("approved")), "y",
                                        "declined", "sex"),
    f"""SELECT *, 1 - tpr AS miss_rate, base_rate / (1 - base_rate) * (1 - ppv) / ppv * tpr AS fpr_from_identity FROM (
        SELECT sex, avg(y) AS base_rate, avg(CASE WHEN p >= {LIMIT}e0 THEN y END) AS ppv,
        avg(CASE WHEN y = 1 THEN CASE WHEN p >= {LIMIT}e0 THEN 1e0 ELSE 0e0 END END) AS tpr,
        avg(CASE WHEN y = 0 THEN CASE WHEN p >= {LIMIT}e0 THEN 1e0 ELSE 0e0 END END) AS fpr FROM scores GROUP BY 1)""",
    ["scores"])
add("fa_9_rate_interval", "s:sex i:n d6:rate,mean_p,low,high,gap",
    lambda s, d: fairness.rate_interval(rows(s, d), "y", "p", "sex"),
    """SELECT sex, n, rate, mean_p, rate - 1.96e0 * sqrt(rate * (1 - rate) / n) AS low,
       rate + 1.96e0 * sqrt(rate * (1 - rate) / n) AS high, rate - mean_p AS gap FROM (
       SELECT sex, count(*) AS n, avg(y) AS rate, avg(p) AS mean_p FROM scores GROUP BY 1)""", ["scores"])
add("prj_19_age_band", "i:id s:band", rows, f"SELECT id, {BAND} AS band FROM scores", ["scores"])
