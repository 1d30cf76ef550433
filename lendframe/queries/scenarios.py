"""Counterfactuals and scenarios on the stored history: the score also depends on ratios across tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lendframe.functions.stable import sigmoid
from lendframe.operators import contributions as con
from lendframe.operators import drift
from lendframe.plans import what_if
from lendframe.plans.adapters import duck_view, view
from lendframe.queries.explaining import _DECISION, BASE, BREAK_EVEN, LINEAR, Q_DEFAULT, Q_REPAY
from lendframe.queries.features import ALL_VIEWS, FEATURES_SQL, by_applicant, features
from lendframe.queries.registry import add
from lendframe.session import durable

# the linear model with ratios between the application and its history: feature -> (coefficient, mean)
MODEL = LINEAR | {"BUR_DEBT_TO_INCOME": (0.15, 20.0), "BUR_ANNUITY_BURDEN": (0.4, 1.0), "PREV_CURRENT_TO_MEAN_CREDIT": (0.3, 1.0)}
WATCHED = ["p", "APP_AMT_INCOME_TOTAL", "APP_CREDIT_TO_INCOME", "APP_EXT_MEAN", "BUR_DEBT_TO_INCOME", "BUR_ANNUITY_BURDEN",
           "PREV_CURRENT_TO_MEAN_CREDIT"]


def history_score(df):
    """p of feature rows; a missing value pushes nowhere."""
    pushes = [F.coalesce(b * (F.col(c).cast("double") - m), F.lit(0.0)) for c, (b, m) in MODEL.items()]
    return df.withColumn("p", sigmoid(reduce(lambda x, y: x + y, pushes, F.lit(BASE))))


def _decided(df):
    return what_if.scored_decisions(df, Q_REPAY, Q_DEFAULT, BREAK_EVEN)


def _counterfactuals(s, d):
    stored = durable(features(s, d))  # used for the decisions and again for every change
    goals = _decided(history_score(stored)).withColumns(what_if.next_goal(F.col("outcome"), 1 - Q_DEFAULT, Q_REPAY))
    targets = goals.where("target IS NOT NULL").select("SK_ID_CURR", "target")
    return what_if.counterfactuals(by_applicant(s, d)(view(s, d, "application")), stored, history_score, targets)


def _scenarios(s, d):
    stored = durable(features(s, d))
    rows = what_if.scenario_rows(by_applicant(s, d)(view(s, d, "application")), stored, history_score)
    return history_score(stored), durable(_decided(rows).select("SK_ID_CURR", "scenario", "outcome", *WATCHED))


def _decision_changes(s, d):
    before, after = _scenarios(s, d)
    return what_if.decision_changes(_decided(before), after)


def _shift(s, d):
    before, after = _scenarios(s, d)
    return drift.psi_by(before, after, "scenario", WATCHED)


def _summary(s, d):
    before, after = _scenarios(s, d)
    shift = drift.psi_by(before, after, "scenario", WATCHED)
    per = shift.groupBy("scenario").agg(
        F.max(F.when(F.col("column") == "p", F.col("psi"))).alias("score_psi"),
        F.max(F.when(F.col("column") != "p", F.col("psi"))).alias("largest_feature_psi"),
        F.count_if((F.col("column") != "p") & (F.col("status") == "shift")).alias("shifted"))
    mean = after.groupBy("scenario").agg(
        F.avg("p").alias("mean_p"), *[F.avg((F.col("outcome") == x).cast("double")).alias(x) for x in ("approve", "decline")])
    return per.join(mean, on="scenario").withColumn("status", drift.status(F.col("score_psi")))


def _number(x: float) -> str:
    return f"{x:e}"


_PUSHES = " + ".join([f"({_number(BASE)})"] + [f"coalesce({_number(b)} * ({c} - {_number(m)}), 0)" for c, (b, m) in MODEL.items()])
_P = f"1 / (1 + exp(-({_PUSHES})))"
#: Features of applicants whose income, loan and external scores are multiplied by fi, fl and fe.
_MOVED = """SELECT * REPLACE (APP_AMT_INCOME_TOTAL * fi AS APP_AMT_INCOME_TOTAL, APP_AMT_CREDIT * fl AS APP_AMT_CREDIT,
    APP_EXT_SOURCE_2 * fe AS APP_EXT_SOURCE_2, APP_EXT_MEAN * fe AS APP_EXT_MEAN,
    APP_AMT_CREDIT * fl / nullif(APP_AMT_INCOME_TOTAL * fi, 0) AS APP_CREDIT_TO_INCOME,
    BUR_ACTIVE_DEBT_TOTAL / nullif(APP_AMT_INCOME_TOTAL * fi, 0) AS BUR_DEBT_TO_INCOME,
    (coalesce(BUR_ACTIVE_ANNUITY_TOTAL, 0) + APP_AMT_ANNUITY * fl) / nullif(APP_AMT_INCOME_TOTAL * fi, 0) AS BUR_ANNUITY_BURDEN,
    APP_AMT_CREDIT * fl / nullif(PREV_CREDIT_MEAN, 0) AS PREV_CURRENT_TO_MEAN_CREDIT) FROM """
_BASE_CTES = ", ".join(duck_view(v) for v in ALL_VIEWS) + ", " + FEATURES_SQL + f""",
  was AS (SELECT *, {_DECISION} AS outcome FROM (SELECT *, {_P} AS p FROM features))"""


def _grid() -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS option, {'f' if name == 'higher income' else '1e0'} AS fi, "
                              f"{'f' if name == 'smaller loan' else '1e0'} AS fl, f FROM (SELECT unnest([{', '.join(map(_number, fs))}]) AS f)"
                              for name, (_, fs) in what_if.OPTIONS.items())


_FOUND_CTES = _BASE_CTES + f""",
  goals AS (SELECT * RENAME (p AS p_before), CASE outcome WHEN 'decline' THEN 45e-2 WHEN 'refer' THEN 2e-1 END AS cut FROM was WHERE outcome <> 'approve'),
  grid AS ({_grid()}),
  tried AS (SELECT *, {_P} AS p FROM ({_MOVED} (SELECT *, 1e0 AS fe FROM goals, grid WHERE CASE option
      WHEN 'smaller loan' THEN APP_AMT_CREDIT > 0 AND APP_AMT_ANNUITY > 0 ELSE APP_AMT_INCOME_TOTAL > 0 END AND p_before >= cut))),
  found AS (SELECT SK_ID_CURR, option, CASE option WHEN 'smaller loan' THEN max(f) FILTER (p < cut) ELSE min(f) FILTER (p < cut) END AS factor,
      max(p_before) AS p_before FROM tried GROUP BY 1, 2)"""
add("ex_10_history_counterfactuals", "i:SK_ID_CURR s:option d:factor,p_before", _counterfactuals, "SELECT * FROM found", (), _FOUND_CTES)
add("ex_12_history_reachability", "s:option d:reachable,median_factor", lambda s, d: what_if.reachability(_counterfactuals(s, d)),
    """SELECT option, avg(CASE WHEN factor IS NOT NULL THEN 1e0 ELSE 0e0 END) AS reachable, quantile_cont(factor, 0.5e0) AS median_factor
       FROM found GROUP BY 1""", (), _FOUND_CTES)



def _table_importance(s, d):
    impacts = [F.struct(F.lit(c).alias("feature"), F.coalesce(b * (F.col(c).cast("double") - m), F.lit(0.0)).alias("impact"))
               for c, (b, m) in MODEL.items()]
    return con.family_importance(features(s, d).select(F.col("SK_ID_CURR").alias("id"), F.inline(F.array(*impacts))))


def _impact_sql(prefix: str) -> str:
    return " + ".join(f"coalesce({_number(b)} * ({c} - {_number(m)}), 0)" for c, (b, m) in MODEL.items() if c.startswith(prefix))


add("ex_2_table_importance", "s:family d6:importance,share", _table_importance,
    "SELECT family, importance, importance / sum(importance) OVER () AS share FROM (" + " UNION ALL ".join(
        f"SELECT '{family}' AS family, avg(abs({_impact_sql(prefix)})) AS importance FROM features" for prefix, family in (
            ("APP_", "Application"), ("BUR_", "Credit bureau"), ("PREV_", "Previous applications"))) + ")", (), _BASE_CTES)

_SCENARIO_CTES = _BASE_CTES + ", settings AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS scenario, " + ", ".join(f"{_number(factor if field in fields else 1.0)} AS {f}" for f, field in (
        ("fi", "income"), ("fe", "ext_source_2"), ("fl", "loan_amount"))) for name, (fields, factor) in what_if.SCENARIOS.items()) + f"""),
  now AS (SELECT *, {_DECISION} AS outcome FROM (SELECT *, {_P} AS p FROM ({_MOVED} (SELECT * FROM features, settings))))"""
add("ex_14_decision_changes", "s:scenario,before,after i:n", _decision_changes,
    """SELECT scenario, was.outcome AS before, now.outcome AS after, count(*) AS n FROM now JOIN was USING (SK_ID_CURR) GROUP BY ALL""",
    (), _SCENARIO_CTES)


def _shift_sql() -> str:
    edges = ", ".join(f"{i / 10}e0" for i in range(1, 10))
    one = []
    for c in WATCHED:
        one.append(f"""SELECT scenario, '{c}' AS "column", late, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(list_distinct(e), lambda x: x <= v)) END AS bin
          FROM (SELECT scenario, 0 AS late, CAST({c} AS DOUBLE) AS v FROM was, settings UNION ALL SELECT scenario, 1, {c} FROM now),
               (SELECT quantile_cont(CAST({c} AS DOUBLE), [{edges}]) AS e FROM was)""")
    return f"""shift AS (SELECT *, CASE WHEN psi < 0.1e0 THEN 'stable' WHEN psi <= 0.25e0 THEN 'watch' ELSE 'shift' END AS status FROM (
      SELECT scenario, "column", sum((q - r) * ln(q / r)) AS psi FROM (
        SELECT scenario, "column", greatest(sum(1 - late) / sum(sum(1 - late)) OVER w, 1e-4) AS r, greatest(sum(late) / sum(sum(late)) OVER w, 1e-4) AS q
        FROM ({' UNION ALL '.join(one)}) GROUP BY scenario, "column", bin WINDOW w AS (PARTITION BY scenario, "column")) GROUP BY 1, 2))"""


add("ex_14_feature_shift", "s:scenario,column,status d6:psi", _shift, "SELECT * FROM shift", (), _SCENARIO_CTES + ", " + _shift_sql())
add("ex_14_scenario_table", "s:scenario,status i:shifted d6:score_psi,largest_feature_psi,mean_p,approve,decline", _summary,
    """SELECT * FROM (SELECT scenario, max(psi) FILTER ("column" = 'p') AS score_psi, max(psi) FILTER ("column" <> 'p') AS largest_feature_psi,
         count(*) FILTER ("column" <> 'p' AND status = 'shift') AS shifted, max(status) FILTER ("column" = 'p') AS status FROM shift GROUP BY 1)
       JOIN (SELECT scenario, avg(p) AS mean_p, avg(CASE outcome WHEN 'approve' THEN 1e0 ELSE 0e0 END) AS approve,
         avg(CASE outcome WHEN 'decline' THEN 1e0 ELSE 0e0 END) AS decline FROM now GROUP BY 1) USING (scenario)""",
    (), _SCENARIO_CTES + ", " + _shift_sql())
