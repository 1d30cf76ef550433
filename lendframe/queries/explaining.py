"""Contributions, reasons, what-if features, counterfactuals and profiles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lendframe.functions.stable import sigmoid
from lendframe.models import learners
from lendframe.operators import contributions as con
from lendframe.operators import drift
from lendframe.plans import application, feature_table, what_if
from lendframe.plans.adapters import raw, view
from lendframe.queries.encoding import MODEL_INPUTS, model_rows
from lendframe.queries.features import (ALL_VIEWS, APP_SPEC, APP_SQL, FEATURES_SQL, _APP_MADE, _APP_NUM, features)
from lendframe.queries.modelling import FEW, halves
from lendframe.queries.registry import add
from lendframe.plans.adapters import duck_view
from lendframe.operators.joins import beside

APP = ["application"]
# a fixed linear model: feature -> (coefficient, mean)
LINEAR = {"APP_AMT_INCOME_TOTAL": (-2e-4, 5500.0), "APP_AMT_CREDIT": (1e-4, 2500.0), "APP_EXT_SOURCE_2": (-0.9, 0.5),
          "APP_EXT_MEAN": (-0.7, 0.5), "APP_AGE_YEARS": (-0.02, 45.0), "APP_CREDIT_TO_INCOME": (0.3, 0.6),
          "APP_DAYS_EMPLOYED_ANOM": (0.2, 0.15)}
BASE = -1.2


def app_features(s, d):
    return application.application_features(view(s, d, "application"))


def with_impacts(df):
    cols = {c: F.col(c) for c in LINEAR}
    impacts = con.linear_contributions(cols, [b for b, _ in LINEAR.values()], [m for _, m in LINEAR.values()])
    # a missing value pushes nowhere
    return df.withColumn("impacts", F.transform(impacts, lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"), F.coalesce(c["impact"], F.lit(0.0)).alias("impact"))))


def logit():
    return F.aggregate("impacts", F.lit(BASE), lambda a, c: a + c["impact"])


def long(s, d):
    return with_impacts(app_features(s, d)).select(F.col("SK_ID_CURR").alias("id"), F.explode("impacts").alias("c")).select(
        "id", "c.feature", "c.value", "c.impact")


LONG_SQL = APP_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT SK_ID_CURR AS id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, coalesce({b!r}e0 * ({c} - {m!r}e0), 0) AS impact FROM app".replace("e-05e0", "e-05")
    for c, (b, m) in LINEAR.items()) + ")"
LONG_SQL = LONG_SQL.replace("0.0002e0", "2e-4").replace("0.0001e0", "1e-4")
add("ex_1_linear_contributions", "i:id s:feature d:value,impact", long, "SELECT * FROM long", APP, LONG_SQL)
add("ex_2_feature_importance", "s:feature d6:importance", lambda s, d: con.feature_importance(long(s, d)),
    "SELECT feature, avg(abs(impact)) AS importance FROM long GROUP BY 1", APP, LONG_SQL)


def _family(s, d):
    """The importance of source tables, one of the columns standing in for a history table."""
    rows = long(s, d).withColumn("feature", F.when(F.col("feature").isin("APP_EXT_MEAN", "APP_CREDIT_TO_INCOME"),
                                                   F.regexp_replace("feature", "^APP_", "BUR_")).otherwise(F.col("feature")))
    return con.family_importance(rows)


add("ex_2_family_importance", "s:family d6:importance,share", _family,
    """SELECT family, importance, importance / sum(importance) OVER () AS share FROM (
       SELECT family, avg(abs(total)) AS importance FROM (SELECT id, CASE WHEN feature IN ('APP_EXT_MEAN', 'APP_CREDIT_TO_INCOME')
         THEN 'Credit bureau' ELSE 'Application' END AS family, sum(impact) AS total FROM long GROUP BY 1, 2) GROUP BY 1)""",
    APP, LONG_SQL)


def _tree_contributions(s, d):
    rows = model_rows(s, d)
    fitted = learners.boosted_trees(FEW, n_trees=5, learning_rate=0.3, depth=3).fit(rows, "y")
    return con.tree_contributions(fitted.ready(rows), "id", fitted.columns, fitted.model.stages[1])


add("ex_1_tree_contributions", "i:id s:feature d:value,impact", _tree_contributions)


def _permutation(s, d):
    train, held = halves(s, d)
    fitted = learners.decision_tree(FEW, 4, 20).fit(train, "y")
    return con.permutation_importance(fitted, held, "id", "y", ["EXT_SOURCE_2", "AMT_CREDIT"], repeats=2)


add("ex_3_permutation_importance", "s:feature d6:importance", _permutation)


def _two_methods(s, d):
    per = long(s, d).groupBy("feature").agg(F.avg(F.abs("impact")).alias("a"), F.stddev_samp("impact").alias("b"))
    return con.rank_correlation(per, "a", "b")


add("ex_4_rank_correlation", "d6:rho", _two_methods,
    """SELECT corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra,
       rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM (
       SELECT feature, avg(abs(impact)) AS a, stddev_samp(impact) AS b FROM long GROUP BY 1))""", APP, LONG_SQL)


def _dependence(s, d):
    train, held = halves(s, d)
    fitted = learners.decision_tree(FEW, 4, 20).fit(train, "y")
    return con.partial_dependence(fitted, held, "EXT_SOURCE_2", [i / 10 for i in range(11)])


add("ex_5_partial_dependence", "d:grid_value i:n d6:mean_p", _dependence)


def _top(s, d):
    rows = with_impacts(app_features(s, d)).withColumns(con.top_reasons(F.col("impacts"), 3))
    both = F.concat(F.transform("raises", lambda r, i: F.struct(F.lit("raises").alias("side"), (i + 1).alias("rank"), r["feature"].alias("feature"), r["impact"].alias("impact"))),
                    F.transform("lowers", lambda r, i: F.struct(F.lit("lowers").alias("side"), (i + 1).alias("rank"), r["feature"].alias("feature"), r["impact"].alias("impact"))))
    return rows.select(F.col("SK_ID_CURR").alias("id"), F.explode(both).alias("r")).select("id", "r.side", "r.rank", "r.feature", "r.impact")


RANKED = """ranked AS (SELECT id, 'raises' AS side, feature, value, impact, row_number() OVER (PARTITION BY id ORDER BY impact DESC, feature) AS rank
  FROM long WHERE impact > 0 UNION ALL SELECT id, 'lowers', feature, value, impact, row_number() OVER (PARTITION BY id ORDER BY impact, feature)
  FROM long WHERE impact < 0)"""
add("top_4_reasons_both_ways", "i:id,rank s:side,feature d:impact", _top,
    "SELECT * FROM ranked WHERE rank <= 3", APP, LONG_SQL + ", " + RANKED)


def _sentences(s, d):
    rows = with_impacts(app_features(s, d)).withColumns(con.top_reasons(F.col("impacts"), 2))
    return rows.select(F.col("SK_ID_CURR").alias("id"), F.array_join(con.reason_texts(F.col("raises")), " ").alias("text"))


def _label_sql() -> str:
    from lendframe.functions.text import LABELS
    return "CASE feature " + " ".join(f"WHEN '{c}' THEN '{LABELS[c]}'" for c in LINEAR) + " END"


_VALUE = """CASE WHEN value IS NULL THEN 'missing' WHEN abs(value) >= 1000 THEN format('{:,}', CAST(round_even(value, 0) AS BIGINT))
  WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE format('{:.3f}', value) END"""
add("ex_6_reason_sentences", "i:id s:text", _sentences,
    f"""SELECT id, coalesce(string_agg(CASE WHEN rank <= 2 AND side = 'raises' THEN {_label_sql()} || ' is ' || {_VALUE} || ', which raised the estimated risk.' END, ' ' ORDER BY rank), '') AS text
        FROM (SELECT DISTINCT id FROM long) LEFT JOIN ranked USING (id) GROUP BY 1""", APP, LONG_SQL + ", " + RANKED)

# ---------------------------------------------------------------- what-if
CHANGES = [("SK_ID_CURR", "SK_ID_CURR"), ("CASE WHEN SK_ID_CURR % 2 = 0 THEN AMT_INCOME_TOTAL * 1.5e0 END", "income"),
           ("CASE WHEN SK_ID_CURR % 3 = 0 THEN AMT_CREDIT * 8e-1 END", "loan_amount"),
           ("CASE WHEN SK_ID_CURR % 5 = 0 THEN 4.15e1 END", "age_years"),
           ("CASE WHEN SK_ID_CURR % 7 = 0 THEN 3.05e1 END", "years_employed"),
           ("CASE WHEN SK_ID_CURR % 11 = 0 THEN 6e-1 END", "ext_source_1")]


def changes(s, d):
    return view(s, d, "application").selectExpr(*[f"{e} AS {n}" for e, n in CHANGES])


CHANGED = """changed AS (SELECT * REPLACE (
  coalesce(CASE WHEN SK_ID_CURR % 2 = 0 THEN AMT_INCOME_TOTAL * 1.5e0 END, AMT_INCOME_TOTAL) AS AMT_INCOME_TOTAL,
  coalesce(CASE WHEN SK_ID_CURR % 3 = 0 THEN AMT_CREDIT * 8e-1 END, AMT_CREDIT) AS AMT_CREDIT,
  coalesce(CASE WHEN SK_ID_CURR % 5 = 0 THEN -15158 END, DAYS_BIRTH) AS DAYS_BIRTH,
  coalesce(CASE WHEN SK_ID_CURR % 7 = 0 THEN -11140 END, DAYS_EMPLOYED) AS DAYS_EMPLOYED,
  coalesce(CASE WHEN SK_ID_CURR % 11 = 0 THEN 6e-1 END, EXT_SOURCE_1) AS EXT_SOURCE_1) FROM {source})"""


def _rebuilt(s, d):
    return what_if.rebuilt_features(what_if.overlay(view(s, d, "application"), changes(s, d)), features(s, d))


WHATIF = ("i:SK_ID_CURR,BUR_HAS_HISTORY d:" + ",".join(f"APP_{c}" for c in _APP_MADE if c != "N_MISSING")
          + ",BUR_DEBT_TO_INCOME,BUR_ANNUITY_BURDEN,PREV_CURRENT_TO_MEAN_CREDIT")
# the SQL twin changes the raw table first and then builds every feature from it
_PLAIN = duck_view("application").replace("application AS (", "plain AS (", 1)
_WHATIF_CTES = (_PLAIN + ", " + CHANGED.format(source="plain").replace("changed AS (", "application AS (", 1) + ", "
                + ", ".join(duck_view(v) for v in ALL_VIEWS if v != "application") + ", " + FEATURES_SQL)
add("ex_7_what_if_features", WHATIF, _rebuilt, "SELECT * FROM features", (), _WHATIF_CTES)


def _validated(s, d):
    rows = what_if.overlay(view(s, d, "application"), changes(s, d))
    bad = changes(s, d).withColumn("income", F.when(F.col("SK_ID_CURR") % 13 == 0, -1.0).otherwise(F.col("income")))
    return rows.select("SK_ID_CURR", what_if.rejection(rows).alias("reason")).join(
        bad.select("SK_ID_CURR", what_if.out_of_range(bad).alias("field")), on="SK_ID_CURR")


add("ex_8_change_checks", "i:SK_ID_CURR s:reason,field", _validated,
    """SELECT SK_ID_CURR, CASE WHEN DAYS_EMPLOYED <> 365243 AND -DAYS_EMPLOYED / 365.25e0 > -DAYS_BIRTH / 365.25e0 - 14
       THEN 'Years employed cannot be more than age minus 14.' END AS reason,
       CASE WHEN SK_ID_CURR % 13 = 0 OR (SK_ID_CURR % 2 = 0 AND income <= 0) THEN 'income' END AS field FROM (SELECT *, AMT_INCOME_TOTAL AS income FROM changed)""",
    APP, CHANGED.format(source="application"))
Q_REPAY, Q_DEFAULT, BREAK_EVEN = 0.45, 0.8, 0.35  # decline above 0.45, approve below 0.2


def linear_score(df):
    scored = with_impacts(df)
    return scored.withColumn("p", sigmoid(logit())).drop("impacts")


def _decided(s, d):
    rows = what_if.rebuilt_features(what_if.overlay(view(s, d, "application"), changes(s, d)), features(s, d))
    return what_if.scored_decisions(linear_score(rows), Q_REPAY, Q_DEFAULT, BREAK_EVEN)


_LOGIT = " + ".join([f"{BASE}e0"] + [f"coalesce({b!r}e0 * ({c} - {m!r}e0), 0)".replace("0.0002e0", "2e-4").replace("0.0001e0", "1e-4")
                                   for c, (b, m) in LINEAR.items()])
_DECISION = """CASE WHEN p <= 0.45e0 AND NOT 1 - p <= 0.8e0 THEN 'approve' WHEN 1 - p <= 0.8e0 AND NOT p <= 0.45e0 THEN 'decline' ELSE 'refer' END"""
add("ex_9_batch_scores", "i:SK_ID_CURR d:p d3:times_average s:outcome,money_rule", _decided,
    f"""SELECT SK_ID_CURR, p, p / 0.0807e0 AS times_average, {_DECISION} AS outcome,
        CASE WHEN p < 0.35e0 THEN 'approve' ELSE 'decline' END AS money_rule
        FROM (SELECT SK_ID_CURR, 1 / (1 + exp(-({_LOGIT}))) AS p FROM app)""", (),
    _PLAIN + ", " + CHANGED.format(source="plain").replace("changed AS (", "application AS (", 1) + "," + APP_SQL)


def _goals(s, d):
    rows = what_if.scored_decisions(linear_score(app_features(s, d)), Q_REPAY, Q_DEFAULT, BREAK_EVEN)
    return rows.withColumns(what_if.next_goal(F.col("outcome"), 1 - Q_DEFAULT, Q_REPAY))


SCORED_SQL = APP_SQL + f", scored AS (SELECT SK_ID_CURR, p, {_DECISION} AS outcome FROM (SELECT SK_ID_CURR, 1 / (1 + exp(-({_LOGIT}))) AS p FROM app))"
add("ex_11_next_decision", "i:SK_ID_CURR s:outcome,goal d:target", _goals,
    """SELECT *, CASE outcome WHEN 'decline' THEN 'refer' WHEN 'refer' THEN 'approve' END AS goal,
       CASE outcome WHEN 'decline' THEN 0.45e0 WHEN 'refer' THEN 0.2e0 END AS target FROM scored""", APP, SCORED_SQL)


class _Linear:
    """The linear score as a fitted model."""
    transform = staticmethod(linear_score)


GRID_VALUES = [0.2, 0.5, 0.8]


def _curves(s, d):
    curves = con.individual_curves(_Linear, app_features(s, d), "SK_ID_CURR", "APP_EXT_MEAN", GRID_VALUES)
    return curves.select("SK_ID_CURR", *[F.col("scores")[i].alias(f"p{i}") for i in range(len(GRID_VALUES))])


def _at(v: float) -> str:
    """The linear score with the mean external score set to v."""
    return "1 / (1 + exp(-(" + _LOGIT.replace("APP_EXT_MEAN", f"{v}e0") + ")))"


add("ex_5_individual_curves", "i:SK_ID_CURR d6:p0,p1,p2", _curves,
    f"SELECT SK_ID_CURR, {', '.join(f'{_at(v)} AS p{i}' for i, v in enumerate(GRID_VALUES))} FROM app", APP, APP_SQL)
add("ex_5_mean_of_curves", "d:grid_value i:n d6:mean_p",
    lambda s, d: con.partial_dependence(_Linear, app_features(s, d), "APP_EXT_MEAN", GRID_VALUES, "SK_ID_CURR"),
    " UNION ALL ".join(f"SELECT {v}e0 AS grid_value, count(*) AS n, avg({_at(v)}) AS mean_p FROM app" for v in GRID_VALUES), APP, APP_SQL)


def _counterfactuals(s, d):
    stored = app_features(s, d).withColumns({c: F.lit(None).cast("double") for c in (
        "BUR_ACTIVE_DEBT_TOTAL", "BUR_ACTIVE_ANNUITY_TOTAL", "PREV_CREDIT_MEAN")})
    targets = _goals(s, d).where("target IS NOT NULL").select("SK_ID_CURR", "target")
    return what_if.counterfactuals(view(s, d, "application"), stored, linear_score, targets)


def _factor_sql() -> str:
    """Linear model by hand: only loan amount or income (and what is built from them) move."""
    b = {c: v[0] for c, v in LINEAR.items()}
    loan = f"({b['APP_AMT_CREDIT']:.1e} * AMT_CREDIT * (f - 1) + {b['APP_CREDIT_TO_INCOME']}e0 * AMT_CREDIT / AMT_INCOME_TOTAL * (f - 1))"
    income = f"({b['APP_AMT_INCOME_TOTAL']:.1e} * AMT_INCOME_TOTAL * (f - 1) + {b['APP_CREDIT_TO_INCOME']}e0 * AMT_CREDIT / AMT_INCOME_TOTAL * (1 / f - 1))"
    lf = ", ".join(f"{x}e0" for x in what_if.OPTIONS["smaller loan"][1])
    hf = ", ".join(f"{x}e0" for x in what_if.OPTIONS["higher income"][1])
    return f"""base AS (SELECT a.*, ln(p / (1 - p)) AS z, p AS p_before, CASE outcome WHEN 'decline' THEN 0.45e0 WHEN 'refer' THEN 0.2e0 END AS cut
      FROM application a JOIN scored USING (SK_ID_CURR) WHERE outcome <> 'approve'),
    tried AS (SELECT SK_ID_CURR, 'smaller loan' AS option, f, row_number() OVER () AS step, cut, p_before, 1 / (1 + exp(-(z + {loan}))) AS p
        FROM base, (SELECT unnest([{lf}]) AS f) WHERE AMT_ANNUITY IS NOT NULL AND AMT_INCOME_TOTAL IS NOT NULL
      UNION ALL SELECT SK_ID_CURR, 'higher income', f, 0, cut, p_before, 1 / (1 + exp(-(z + {income})))
        FROM base, (SELECT unnest([{hf}]) AS f) WHERE AMT_INCOME_TOTAL > 0),
    found AS (SELECT SK_ID_CURR, option, CASE WHEN option = 'smaller loan' THEN max(f) FILTER (p < cut) ELSE min(f) FILTER (p < cut) END AS factor,
      max(p_before) AS p_before FROM tried WHERE p_before >= cut GROUP BY 1, 2)"""


add("ex_10_counterfactuals", "i:SK_ID_CURR s:option d:factor,p_before", _counterfactuals, "SELECT * FROM found", APP,
    SCORED_SQL + ", " + _factor_sql())
add("ex_12_reachability", "s:option d:reachable,median_factor", lambda s, d: what_if.reachability(_counterfactuals(s, d)),
    """SELECT option, avg(CASE WHEN factor IS NOT NULL THEN 1e0 ELSE 0e0 END) AS reachable, quantile_cont(factor, 0.5e0) AS median_factor
       FROM found GROUP BY 1""", APP, SCORED_SQL + ", " + _factor_sql())


def _profile(s, d):
    rows = what_if.profile(view(s, d, "application"), features(s, d))
    return rows.withColumnsRenamed({"Contract type": "contract", "Goods price": "goods", "Credit cards": "cards"}).withColumn(
        "cards", F.col("cards").cast("int"))


add("ex_13_profile", "i:SK_ID_CURR,cards s:contract,goods d2:income d1:age_years,years_employed d:ext_source_1", _profile,
    """SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR IN (SELECT user_id FROM events) THEN 1 ELSE 0 END AS cards, NAME_CONTRACT_TYPE AS contract,
       CASE WHEN AMT_GOODS_PRICE IS NULL THEN 'missing' WHEN AMT_GOODS_PRICE >= 1000 THEN format('{:,}', CAST(AMT_GOODS_PRICE AS BIGINT))
         ELSE CAST(CAST(AMT_GOODS_PRICE AS BIGINT) AS VARCHAR) END AS goods, AMT_INCOME_TOTAL AS income, round(-DAYS_BIRTH / 365.25e0, 1) AS age_years,
       round(-nullif(DAYS_EMPLOYED, 365243) / 365.25e0, 1) AS years_employed, EXT_SOURCE_1 AS ext_source_1 FROM application""", APP)


def _scenario(s, d):
    """All applicants with external scores down a fifth: decisions before and after, and score drift."""
    rows = view(s, d, "application")
    lower = rows.select("SK_ID_CURR", *[(F.col(f"EXT_SOURCE_{i}") * 0.8).alias(f"ext_source_{i}") for i in (1, 2, 3)])
    stored = app_features(s, d).withColumns({c: F.lit(None).cast("double") for c in (
        "BUR_ACTIVE_DEBT_TOTAL", "BUR_ACTIVE_ANNUITY_TOTAL", "PREV_CREDIT_MEAN")})
    before = linear_score(stored).select("SK_ID_CURR", "p")
    after = linear_score(what_if.rebuilt_features(what_if.overlay(rows, lower), stored)).select("SK_ID_CURR", "p")
    shift = drift.psi_table(before, after, numeric=["p"]).select("psi", "status")
    means = [df.agg(F.avg("p").alias(n)) for df, n in ((before, "p_before"), (after, "p_after"))]
    return shift.transform(beside, means[0]).transform(beside, means[1])


_APP_AFTER = APP_SQL.replace("app_base AS", "app_base2 AS").replace("FROM app_base)", "FROM app_base2)").replace(
    "FROM application)", "FROM lowered)").replace("app AS (", "app2 AS (")
add("ex_14_scenario", "s:status d6:psi,p_before,p_after", _scenario,
    """SELECT psi, p_before, p_after, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'watch' ELSE 'shift' END AS status FROM (
       SELECT sum((q - r) * ln(q / r)) AS psi FROM (SELECT greatest(sum(1 - late) / sum(sum(1 - late)) OVER (), 1e-4) AS r,
         greatest(sum(late) / sum(sum(late)) OVER (), 1e-4) AS q FROM (SELECT late, len(list_filter(list_distinct(e), lambda x: x <= p)) AS bin
         FROM (SELECT 0 AS late, p FROM before UNION ALL SELECT 1, p FROM after), (SELECT quantile_cont(p, ["""
    + ", ".join(f"{i / 10}e0" for i in range(1, 10)) + """]) AS e FROM before)) GROUP BY bin)),
       (SELECT avg(p) AS p_before FROM before), (SELECT avg(p) AS p_after FROM after)""", APP,
    APP_SQL + """, lowered AS (SELECT * REPLACE (EXT_SOURCE_1 * 0.8e0 AS EXT_SOURCE_1, EXT_SOURCE_2 * 0.8e0 AS EXT_SOURCE_2,
      EXT_SOURCE_3 * 0.8e0 AS EXT_SOURCE_3) FROM application), """ + _APP_AFTER.strip()
    + f""", before AS (SELECT 1 / (1 + exp(-({_LOGIT}))) AS p FROM app), after AS (SELECT 1 / (1 + exp(-({_LOGIT}))) AS p FROM app2)""")
