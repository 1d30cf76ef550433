"""Data quality reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lendframe.operators import profiling
from lendframe.plans.adapters import VIEWS, raw, view
from lendframe.queries.registry import add

APP = ["application"]
#: All columns of the application but its key, label and set.
ALL = [name for _, name in VIEWS["application"][0] if name not in ("SK_ID_CURR", "TARGET", "is_test")]
TEXTS = [c for c in ALL if c.startswith("NAME_") or c in ("CODE_GENDER", "OCCUPATION_TYPE", "ORGANIZATION_TYPE")]
NUMBERS = [c for c in ALL if c not in TEXTS]
MISSING = ALL
PAIRED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2"]


def app(s, d):
    return view(s, d, "application")


def union(template: str, cols) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


add("dq_1_key_checks", "i:rows,keys,missing,repeated",
    lambda s, d: profiling.key_checks(view(s, d, "bureau_balance"), "SK_ID_BUREAU"),
    """SELECT sum(n) AS rows, count(SK_ID_BUREAU) AS keys, coalesce(sum(n) FILTER (SK_ID_BUREAU IS NULL), 0) AS missing,
       count(*) FILTER (SK_ID_BUREAU IS NOT NULL AND n > 1) AS repeated
       FROM (SELECT SK_ID_BUREAU, count(*) AS n FROM bureau_balance GROUP BY 1)""", ["bureau_balance"])
add("set_2_overlap", "i:shared",
    lambda s, d: profiling.overlap(app(s, d).where("is_test = 0"), app(s, d).where("is_test = 1"), "SK_ID_CURR"),
    """SELECT count(*) AS shared FROM (SELECT SK_ID_CURR FROM application WHERE is_test = 0
       INTERSECT SELECT SK_ID_CURR FROM application WHERE is_test = 1)""", APP)
add("set_3_distinct_keys", "i:ids", lambda s, d: view(s, d, "pos_cash_balance").select("SK_ID_CURR").distinct()
    .agg(F.count("*").alias("ids")),
    "SELECT count(DISTINCT SK_ID_CURR) AS ids FROM pos_cash_balance", ["pos_cash_balance"])
add("dq_2_missing_shares", "s:column d6:missing_share i:over_half",
    lambda s, d: profiling.missing_shares(app(s, d), MISSING),
    f"""SELECT *, CASE WHEN missing_share > 0.5 THEN 1 ELSE 0 END AS over_half FROM (
        {union("SELECT '{c}' AS column, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS missing_share FROM application", MISSING)})""".replace(" AS column,", ' AS "column",'),
    APP)
add("dq_3_label_by_missing", "s:column i:n_missing d6:rate_missing,rate_present",
    lambda s, d: profiling.label_rate_by_missing(app(s, d), MISSING, "TARGET"),
    union("""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_missing, avg(TARGET) FILTER ({c} IS NULL) AS rate_missing,
       avg(TARGET) FILTER ({c} IS NOT NULL) AS rate_present FROM application WHERE TARGET IS NOT NULL""", MISSING), APP)
DAYS = [c for c in ALL if c.startswith("DAYS_")]
add("dq_4_day_columns", "s:column i:sentinels d:min_days,max_days,min_years",
    lambda s, d: profiling.day_columns(app(s, d), DAYS),
    union("""SELECT '{c}' AS "column", count(*) FILTER ({c} = 365243) AS sentinels, min(nullif({c}, 365243)) AS min_days,
       max(nullif({c}, 365243)) AS max_days, min(nullif({c}, 365243)) / 365.25e0 AS min_years FROM application""", DAYS), APP)
CONSTANTS = ALL
add("dq_5_near_constant", "s:column d6:top_share i:near_constant",
    lambda s, d: profiling.near_constant(app(s, d), CONSTANTS),
    union("""SELECT '{c}' AS "column", max(n) / sum(n) AS top_share, CASE WHEN max(n) / sum(n) > 0.99 THEN 1 ELSE 0 END AS near_constant
       FROM (SELECT {c} AS v, count(*) AS n FROM application GROUP BY 1)""", CONSTANTS), APP)
add("dq_6_status_counts", "s:value i:n d6:share",
    lambda s, d: profiling.value_shares(view(s, d, "bureau_balance"), "STATUS"),
    """SELECT STATUS AS value, count(*) AS n, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM bureau_balance) AS share
       FROM bureau_balance GROUP BY 1""", ["bureau_balance"])
PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]
_P = ", ".join(f"{p}e0" for p in PROBS)


def _flat(df):
    return df.select("column", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(len(PROBS))])


add("dq_7_quantile_profile", "s:column i:n d:q0,q1,q2,q3,q4",
    lambda s, d: _flat(profiling.quantile_profile(app(s, d), NUMBERS, PROBS)),
    union("""SELECT '{c}' AS "column", count({c}) AS n, """ + ", ".join(
        f"quantile_cont({{c}}, {p}e0) AS q{i}" for i, p in enumerate(PROBS)) + " FROM application", NUMBERS), APP)
add("dq_7_line_quantiles", "s:column i:n d2:q0,q1,q2,q3,q4",
    lambda s, d: _flat(profiling.quantile_profile(raw(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], PROBS)),
    union("""SELECT '{c}' AS "column", count({c}) AS n, """ + ", ".join(
        f"quantile_cont({{c}}, {p}e0) AS q{i}" for i, p in enumerate(PROBS)) + " FROM lineitem",
        ["l_extendedprice", "l_quantity"]))
SETS = TEXTS
add("dq_8_compare_sets", "s:column,value d6:in_a,in_b",
    lambda s, d: profiling.compare_sets(app(s, d).where("is_test = 0"), app(s, d).where("is_test = 1"), SETS,
                                        NUMBERS),
    union("""SELECT '{c}' AS "column", {c} AS value, sum(1 - is_test) / sum(sum(1 - is_test)) OVER () AS in_a,
       sum(is_test) / sum(sum(is_test)) OVER () AS in_b FROM application GROUP BY {c}""", SETS) + " UNION ALL " +
    union("""SELECT '{c}' AS "column", '(mean)' AS value, avg({c}) FILTER (is_test = 0) AS in_a,
       avg({c}) FILTER (is_test = 1) AS in_b FROM application""", NUMBERS), APP)
add("dq_9_spearman", "s:column d6:rho",
    lambda s, d: profiling.spearman_with_label(app(s, d), NUMBERS, "TARGET"),
    union("""SELECT '{c}' AS "column", CASE WHEN isfinite(corr(r, y)) THEN corr(r, y) END AS rho FROM (SELECT TARGET AS y, rank() OVER (ORDER BY {c})
       + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS r FROM application WHERE TARGET IS NOT NULL AND {c} IS NOT NULL)""",
          NUMBERS), APP)
add("dq_10_correlated_pairs", "s:a,b d6:r",
    lambda s, d: profiling.correlated_pairs(app(s, d), PAIRED, 0.5),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM application"
                                           for a, b in combinations(PAIRED, 2)) + ") WHERE abs(r) > 0.5", APP)
add("agg_10_label_rate_by_value", "s:value i:n d6:rate",
    lambda s, d: profiling.label_rate_by_value(app(s, d), "ORGANIZATION_TYPE", "TARGET", 15, 10),
    """SELECT ORGANIZATION_TYPE AS value, count(TARGET) AS n, avg(TARGET) AS rate FROM application GROUP BY 1
       HAVING count(TARGET) >= 10 AND ORGANIZATION_TYPE IS NOT NULL ORDER BY n DESC, value LIMIT 15""", APP)
HISTORY = ["previous_application", "pos_cash_balance", "credit_card_balance", "bureau", "installments_payments", "bureau_months"]


def _history(s, d, name):
    """The months of credit bureau loans have the loan's key only."""
    if name != "bureau_months":
        return view(s, d, name)
    return view(s, d, "bureau_balance").select("SK_ID_BUREAU").join(view(s, d, "bureau").select("SK_ID_BUREAU", "SK_ID_CURR"), "SK_ID_BUREAU")


add("agg_11_table_coverage", "s:table d6:covered_share,rate_with,rate_without",
    lambda s, d: profiling.table_coverage(app(s, d).where("is_test = 0"), {h: _history(s, d, h) for h in HISTORY}, "TARGET"),
    union("""SELECT '{c}' AS "table", avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS covered_share, avg(TARGET) FILTER (hit) AS rate_with,
       avg(TARGET) FILTER (NOT hit) AS rate_without FROM (SELECT TARGET, SK_ID_CURR IN (SELECT SK_ID_CURR FROM {c}) AS hit
       FROM application WHERE is_test = 0)""", HISTORY), APP + HISTORY[:-1] + ["bureau_balance"],
    "bureau_months AS (SELECT SK_ID_CURR FROM bureau_balance JOIN bureau USING (SK_ID_BUREAU))")
add("agg_12_cross_shares", "s:NAME_EDUCATION_TYPE d6:F,M,XNA",
    lambda s, d: profiling.cross_shares(app(s, d), "NAME_EDUCATION_TYPE", "CODE_GENDER", ["F", "M", "XNA"]),
    """SELECT NAME_EDUCATION_TYPE, """ + ", ".join(f"count(*) FILTER (CODE_GENDER = '{g}') / (SELECT CAST(count(*) AS DOUBLE) FROM application) AS \"{g}\""
                                                   for g in ("F", "M", "XNA")) + " FROM application GROUP BY 1", APP)
USELESS = ALL
add("prj_24_uninformative", "s:column i:levels,useless",
    lambda s, d: profiling.distinct_counts(app(s, d), USELESS).withColumn(
        "useless", (F.col("levels") < 2).cast("int")),
    union("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS levels, CASE WHEN count(DISTINCT {c}) < 2 THEN 1 ELSE 0 END AS useless
       FROM application""", USELESS), APP)
GROUPED = ALL
add("prj_21_column_groups", "s:column,kind i:levels", lambda s, d: _groups(s, d),
    union("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS levels, CASE WHEN max(typeof({c})) <> 'VARCHAR' THEN 'number'
       WHEN count(DISTINCT {c}) <= 10 THEN 'small text' ELSE 'large text' END AS kind FROM application""", GROUPED), APP)


def _groups(s, d):
    from lendframe.operators.encoders import column_groups
    return column_groups(app(s, d).select(*GROUPED))
