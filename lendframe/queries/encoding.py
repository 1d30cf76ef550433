"""Encoders and the scorecard."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lendframe.models.learners import Inputs, important_columns
from lendframe.operators import encoders, woe
from lendframe.plans.adapters import raw, view
from lendframe.queries.registry import add
from lendframe.queries.sampling import hash_sql, hex_sql
from lendframe.session import tasks_for

APP = ["application"]
LABELLED = "(SELECT * FROM application WHERE TARGET IS NOT NULL)"


def labelled(s, d):
    return view(s, d, "application").where("TARGET IS NOT NULL")


NUM = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "EXT_SOURCE_1", "OWN_CAR_AGE"]


def _clipped(s, d):
    rows = labelled(s, d)
    caps = encoders.fit_clipper(rows, NUM, 0.05, 0.95)
    return rows.select("SK_ID_CURR", *[encoders.clip(F.col(c).cast("double"), caps.get(c)).alias(c) for c in NUM])


CAPS = "caps AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05e0) AS lo_{c}, quantile_cont({c}, 0.95e0) AS hi_{c}"
                                      for c in NUM) + f" FROM {LABELLED})"
_CLIP = "CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END"
add("enc_1_quantile_clipper", "i:SK_ID_CURR d:" + ",".join(NUM), _clipped,
    "SELECT SK_ID_CURR, " + ", ".join(f"{_CLIP.format(c=c)} AS {c}" for c in NUM) + f" FROM {LABELLED}, caps", APP, CAPS)


def _imputed(s, d):
    rows = labelled(s, d)
    fill = encoders.fit_imputer(rows, NUM)
    return rows.select("SK_ID_CURR", *[F.coalesce(F.col(c).cast("double"), F.lit(fill[c][0])).alias(c) for c in NUM],
                       *[F.isnull(c).cast("int").alias(f"{c}_missing") for c in NUM if fill[c][1]])


_HOLED = [c for c in NUM if c != "AMT_INCOME_TOTAL"]
add("enc_2_impute", f"i:SK_ID_CURR,{','.join(f'{c}_missing' for c in _HOLED)} d:" + ",".join(NUM), _imputed,
    "SELECT SK_ID_CURR, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5e0) FROM {LABELLED})) AS {c}" for c in NUM)
    + ", " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in _HOLED) + f" FROM {LABELLED}", APP)


def _scaled(s, d):
    rows = labelled(s, d)
    exprs = {c: F.col(c).cast("double") for c in NUM}
    scale = encoders.fit_scaler(rows, exprs)
    return rows.select("SK_ID_CURR", *[((e - scale[c][0]) / scale[c][1]).alias(c) for c, e in exprs.items()])


add("enc_3_standard_scale", "i:SK_ID_CURR d:" + ",".join(NUM), _scaled,
    "SELECT SK_ID_CURR, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in NUM)
    + f" FROM {LABELLED}", APP)


def _one_hot(s, d):
    rows = labelled(s, d)
    levels = encoders.fit_levels(rows, ["OCCUPATION_TYPE"])["OCCUPATION_TYPE"]
    return rows.select("SK_ID_CURR", *[encoders.one_hot(F.col("OCCUPATION_TYPE"), x).alias((x or "none").lower())
                                       for x in levels])


_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
add("enc_4_one_hot", "i:SK_ID_CURR,none," + ",".join(x.lower() for x in _LEVELS), _one_hot,
    "SELECT SK_ID_CURR, CASE WHEN OCCUPATION_TYPE IS NULL THEN 1 ELSE 0 END AS none, " + ", ".join(
        f"CASE WHEN coalesce(OCCUPATION_TYPE, '') = '{x}' THEN 1 ELSE 0 END AS {x.lower()}" for x in _LEVELS)
    + f" FROM {LABELLED}", APP)
FOLDED = f"""folded AS (SELECT SK_ID_CURR, ORGANIZATION_TYPE AS g, TARGET AS y, {hex_sql(hash_sql('SK_ID_CURR', 42))} % 5 AS f FROM {LABELLED}),
own AS (SELECT g, f, sum(y) AS s, count(*) AS n FROM folded GROUP BY 1, 2),
rates AS (SELECT g, f, (sum(s) OVER (PARTITION BY g) - s + 1e1 * (sum(s) OVER () - sum(s) OVER (PARTITION BY f))
    / (sum(n) OVER () - sum(n) OVER (PARTITION BY f))) / (sum(n) OVER (PARTITION BY g) - n + 1e1) AS encoded FROM own)"""
add("enc_5_target_encoding", "i:SK_ID_CURR d6:encoded",
    lambda s, d: encoders.target_encode(labelled(s, d), "SK_ID_CURR", "ORGANIZATION_TYPE", "TARGET"),
    "SELECT SK_ID_CURR, encoded FROM folded JOIN rates USING (g, f)", APP, FOLDED)


def _ordinal(s, d):
    """Codes fitted on even ids and applied to all rows; gender XNA may be unknown there."""
    rows = labelled(s, d)
    levels = encoders.fit_levels(rows.where("CODE_GENDER <> 'XNA'"), ["OCCUPATION_TYPE", "CODE_GENDER"])
    return rows.select("SK_ID_CURR", *[encoders.ordinal(F.col(c), levels[c]).alias(c) for c in levels])


add("enc_6_ordinal", "i:SK_ID_CURR,OCCUPATION_TYPE,CODE_GENDER", _ordinal,
    "SELECT SK_ID_CURR, CASE " + " ".join(f"WHEN OCCUPATION_TYPE = '{x}' THEN {i}" for i, x in enumerate(_LEVELS))
    + f" ELSE -2 END AS OCCUPATION_TYPE, CASE CODE_GENDER WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS CODE_GENDER FROM {LABELLED}",
    APP)

# ---------------------------------------------------------------- weight of evidence
W_NUM = ["AMT_INCOME_TOTAL", "EXT_SOURCE_1", "EXT_SOURCE_3", "CNT_CHILDREN"]
W_TEXT = ["OCCUPATION_TYPE", "ORGANIZATION_TYPE"]
MIN_SHARE = 0.04
_PROBS = ", ".join(f"{i / 10}e0" for i in range(1, 10))


def _num_cells(c: str) -> str:
    return f"""SELECT '{c}' AS "column", bin, good, bad, k FROM (
      SELECT CASE WHEN {c} IS NULL THEN '(missing)' ELSE CAST(len(list_filter(e, lambda x: x <= {c})) AS VARCHAR) END AS bin,
        sum(1 - TARGET) AS good, sum(TARGET) AS bad, max(len(e)) + 2 AS k
      FROM {LABELLED}, (SELECT list_distinct(quantile_cont({c}, [{_PROBS}])) AS e FROM {LABELLED}) GROUP BY 1)"""


def _text_bin(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN '(missing)' WHEN {c} IN (SELECT {c} FROM {LABELLED} WHERE {c} IS NOT NULL GROUP BY 1
      HAVING count(*) / (SELECT CAST(count({c}) AS DOUBLE) FROM {LABELLED}) >= {MIN_SHARE}e0) THEN '=' || {c} ELSE '(other)' END"""


def _text_cells(c: str) -> str:
    return f"""SELECT '{c}' AS "column", bin, good, bad, 1 + count(*) FILTER (bin <> '(missing)') OVER () AS k FROM (
      SELECT {_text_bin(c)} AS bin, sum(1 - TARGET) AS good, sum(TARGET) AS bad FROM {LABELLED} GROUP BY 1)"""


WOE_SQL = f"""cells AS ({' UNION ALL '.join([_num_cells(c) for c in W_NUM] + [_text_cells(c) for c in W_TEXT])}),
shares AS (SELECT *, (good + 0.5e0) / (sum(good) OVER w + 0.5e0 * k) AS g, (bad + 0.5e0) / (sum(bad) OVER w + 0.5e0 * k) AS b
  FROM cells WINDOW w AS (PARTITION BY "column")),
woe AS (SELECT "column", bin, good, bad, ln(g / b) AS woe, sum((g - b) * ln(g / b)) OVER (PARTITION BY "column") AS iv FROM shares)"""


def _bins(s, d):
    return woe.woe_bins(labelled(s, d), "TARGET", W_NUM, W_TEXT, min_share=MIN_SHARE)


add("enc_7_woe_bins", "s:column,bin i:good,bad d6:woe,iv", _bins, "SELECT * FROM woe", APP, WOE_SQL)
add("top_3_selected_by_iv", "s:column d6:iv", lambda s, d: woe.selected(_bins(s, d), 0.02, 4),
    'SELECT "column", max(iv) AS iv FROM woe GROUP BY 1 HAVING max(iv) >= 0.02 ORDER BY 2 DESC, 1 LIMIT 4', APP, WOE_SQL)


def fitted_rules(s, d):
    return woe.fit_woe(labelled(s, d), "TARGET", W_NUM, W_TEXT, min_iv=0.0, min_share=MIN_SHARE)


def _transform(s, d):
    rules = fitted_rules(s, d)
    return labelled(s, d).select("SK_ID_CURR", *[e.alias(n) for n, e in woe.woe_columns(rules).items()])


def _bin_sql(c: str) -> str:
    if c in W_TEXT:
        return _text_bin(c)
    return f"""CASE WHEN {c} IS NULL THEN '(missing)' ELSE CAST(len(list_filter((SELECT list_distinct(quantile_cont({c}, [{_PROBS}]))
      FROM {LABELLED}), lambda x: x <= {c})) AS VARCHAR) END"""


ALL_W = W_NUM + W_TEXT
BINNED = "binned AS (SELECT SK_ID_CURR, " + ", ".join(f"{_bin_sql(c)} AS {c}" for c in ALL_W) + f" FROM {LABELLED})"
_JOINS = " ".join(f"""JOIN (SELECT bin, woe FROM woe WHERE "column" = '{c}') w_{c} ON w_{c}.bin = b.{c}""" for c in ALL_W)
add("enc_8_woe_transform", "i:SK_ID_CURR d6:" + ",".join(f"{c}_woe" for c in ALL_W), _transform,
    "SELECT SK_ID_CURR, " + ", ".join(f"w_{c}.woe AS {c}_woe" for c in ALL_W) + f" FROM binned b {_JOINS}", APP,
    WOE_SQL + ", " + BINNED)
BETA, BETA0 = -0.8, -1.1  # a fixed scorecard: the same slope for every column
FACTOR = 20 / math.log(2)
SHARE = (600 - FACTOR * math.log(50) - FACTOR * BETA0) / len(ALL_W)


def _scores(s, d):
    rules = fitted_rules(s, d)
    points = woe.scorecard_points(rules, [BETA] * len(rules), BETA0)
    return labelled(s, d).select("SK_ID_CURR", woe.score_column(rules, points).alias("score"))


def _points(s, d):
    rules = fitted_rules(s, d)
    return woe.points_table(s, rules, woe.scorecard_points(rules, [BETA] * len(rules), BETA0))


add("enc_9_scorecard_points", "s:column,bin d6:woe,points,iv", _points,
    f'SELECT "column", bin, woe, {SHARE!r}e0 + {-FACTOR * BETA!r}e0 * woe AS points, iv FROM woe', APP, WOE_SQL)
add("enc_9_scores", "i:SK_ID_CURR d:score", _scores,
    "SELECT SK_ID_CURR, " + " + ".join(f"({SHARE!r}e0 + {-FACTOR * BETA!r}e0 * w_{c}.woe)" for c in ALL_W)
    + f" AS score FROM binned b {_JOINS}", APP, WOE_SQL + ", " + BINNED)

MODEL_INPUTS = Inputs(["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
                       "OWN_CAR_AGE", "DAYS_BIRTH"],
                      ["NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"], ["ORGANIZATION_TYPE"])


def model_rows(s, d):
    """Labelled applicants with key, label and five folds (1..5)."""
    rows = labelled(s, d).withColumn("fold", (encoders.hash_fold("SK_ID_CURR", 5) + 1).cast("int"))
    return rows.withColumnsRenamed({"SK_ID_CURR": "id", "TARGET": "y"})


#: Applicants that one task of a fit holds.
APPLICANTS_A_TASK = 25_000


def rows_to_fit(s, d):
    """The model rows for a fit, which reads them many times: a file of few row groups would be one task each time.

    They are dealt out and written once. What fits into one task is left as it is.
    """
    rows, n = model_rows(s, d), tasks_for(raw(s, d, "customer"), APPLICANTS_A_TASK)
    return rows if n == 1 else encoders.stored(rows.repartition(n), "model-rows")


def _important(s, d):
    rows = rows_to_fit(s, d)
    kept = important_columns(rows, MODEL_INPUTS, "y", k=5, n_trees=5)
    return rows.select(F.explode(F.array(*[F.lit(c) for c in kept])).alias("column")).groupBy("column").agg(
        F.count("*").alias("rows"))


add("enc_10_selected_by_gain", "s:column i:rows", _important)


def _preprocessed(s, d):
    rows = model_rows(s, d)
    fit = encoders.fit_linear(rows, "id", "y", MODEL_INPUTS.numeric, MODEL_INPUTS.small, MODEL_INPUTS.large)
    cols = encoders.linear_columns(fit, crossed=True)
    crossed = encoders.cross_fitted(rows, "id", "y", MODEL_INPUTS.large)
    return crossed.select("id", F.array(*cols.values()).alias("x")).select(
        "id", F.size("x").alias("inputs"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


add("enc_11_linear_inputs", "i:id,inputs d:total", _preprocessed)
