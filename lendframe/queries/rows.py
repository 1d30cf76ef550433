"""Row-level expressions: cleaning, flags, text, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.functions import bins, nulls, rowwise, stable, text
from lendframe.operators.joins import beside
from lendframe.plans import application, bureau, feature_table, previous
from lendframe.plans.adapters import loans_with_months, raw, reader, view
from lendframe.queries.registry import add

APP = ["application"]


def app(s, d):
    return view(s, d, "application")


def one(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


add("prj_1_stack_labelled", "i:is_test,rows,labelled",
    lambda s, d: application.stack_labelled(reader(s, d)("application_train"), reader(s, d)("application_test"))
    .groupBy("is_test").agg(F.count("*").alias("rows"), F.count("TARGET").alias("labelled")),
    "SELECT is_test, count(*) AS rows, count(TARGET) AS labelled FROM application GROUP BY 1", APP)
_NULLABLE = ["OCCUPATION_TYPE", "CNT_FAM_MEMBERS", "AMT_ANNUITY", "EXT_SOURCE_1", "EXT_SOURCE_3"]
add("prj_2_missing_count", "i:SK_ID_CURR,n",
    lambda s, d: app(s, d).select("SK_ID_CURR", nulls.null_count(_NULLABLE).alias("n")),
    f"SELECT SK_ID_CURR, {' + '.join(one(f'{c} IS NULL') for c in _NULLABLE)} AS n FROM application", APP)
add("prj_3_sentinels", "i:SK_ID_CURR,anom d:days s:gender",
    lambda s, d: app(s, d).select(
        "SK_ID_CURR", nulls.flag(F.col("DAYS_EMPLOYED") == 365243).alias("anom"),
        F.nullif(F.col("DAYS_EMPLOYED"), F.lit(365243)).alias("days"),
        F.nullif(F.col("CODE_GENDER"), F.lit("XNA")).alias("gender")),
    f"""SELECT SK_ID_CURR, {one('DAYS_EMPLOYED = 365243')} AS anom, nullif(DAYS_EMPLOYED, 365243) AS days,
        nullif(CODE_GENDER, 'XNA') AS gender FROM application""", APP)
_REQ = application.BUREAU_REQUESTS
_ZERO = " + ".join(f"coalesce({c}, 0)" for c in _REQ)
add("prj_4_row_sums", "i:SK_ID_CURR d:zero_based,null_aware",
    lambda s, d: app(s, d).select("SK_ID_CURR", rowwise.row_sum(_REQ).alias("zero_based"),
                                  rowwise.row_sum_or_null(_REQ).alias("null_aware")),
    f"""SELECT SK_ID_CURR, {_ZERO} AS zero_based, CASE WHEN coalesce({', '.join(_REQ)}) IS NOT NULL
        THEN {_ZERO} END AS null_aware FROM application""", APP)
add("prj_5_days_to_years", "i:SK_ID_CURR d:age,registration",
    lambda s, d: app(s, d).select("SK_ID_CURR", (-F.col("DAYS_BIRTH") / 365.25).alias("age"),
                                  (-F.col("DAYS_REGISTRATION") / 365.25).alias("registration")),
    "SELECT SK_ID_CURR, -DAYS_BIRTH / 365.25e0 AS age, -DAYS_REGISTRATION / 365.25e0 AS registration FROM application",
    APP)
_E = application.EXT
_LIST = f"list_filter([{', '.join(_E)}], lambda x: x IS NOT NULL)"
add("prj_6_row_statistics", "i:SK_ID_CURR,missing d:mean,low,high,std,product",
    lambda s, d: app(s, d).select(
        "SK_ID_CURR", nulls.null_count(_E).alias("missing"), rowwise.row_mean(_E).alias("mean"),
        rowwise.row_min(_E).alias("low"), rowwise.row_max(_E).alias("high"),
        rowwise.row_std(_E).alias("std"), rowwise.row_product(_E).alias("product")),
    f"""SELECT SK_ID_CURR, 3 - len({_LIST}) AS missing, list_aggregate({_LIST}, 'avg') AS mean,
        list_aggregate({_LIST}, 'min') AS low, list_aggregate({_LIST}, 'max') AS high,
        list_aggregate({_LIST}, 'stddev_samp') AS std, {' * '.join(_E)} AS product FROM application""", APP)
add("prj_7_safe_divide", "i:SK_ID_PREV d:ratio",
    lambda s, d: view(s, d, "previous_application").select(
        "SK_ID_PREV", nulls.sdiv(F.col("AMT_APPLICATION"), F.col("AMT_CREDIT")).alias("ratio")),
    "SELECT SK_ID_PREV, AMT_APPLICATION / nullif(AMT_CREDIT, 0) AS ratio FROM previous_application",
    ["previous_application"])
add("prj_8_measures", "i:SK_ID_CURR d:log_income,over_goods,extra_cost",
    lambda s, d: app(s, d).select(
        "SK_ID_CURR", F.log("AMT_INCOME_TOTAL").alias("log_income"),
        (F.col("AMT_CREDIT") - F.col("AMT_GOODS_PRICE")).alias("over_goods"),
        (nulls.sdiv(F.col("AMT_ANNUITY") * 12, F.col("AMT_CREDIT")) - 1).alias("extra_cost")),
    """SELECT SK_ID_CURR, CASE WHEN AMT_INCOME_TOTAL > 0 THEN ln(AMT_INCOME_TOTAL) END AS log_income,
       AMT_CREDIT - AMT_GOODS_PRICE AS over_goods, AMT_ANNUITY * 12 / nullif(AMT_CREDIT, 0) - 1 AS extra_cost FROM application""",
    APP)
add("prj_10_impossible_dates", "i:SK_ID_BUREAU d:planned,actual",
    lambda s, d: bureau.clean_loans(view(s, d, "bureau")).select(
        "SK_ID_BUREAU", F.col("DAYS_CREDIT_ENDDATE").alias("planned"), F.col("DAYS_ENDDATE_FACT").alias("actual")),
    """SELECT SK_ID_BUREAU, CASE WHEN DAYS_CREDIT_ENDDATE >= DAYS_CREDIT AND DAYS_CREDIT_ENDDATE <= 18262.5
       THEN DAYS_CREDIT_ENDDATE END AS planned, CASE WHEN DAYS_ENDDATE_FACT >= DAYS_CREDIT THEN DAYS_ENDDATE_FACT END AS actual
       FROM bureau""", ["bureau"])
add("prj_11_clip_at_zero", "i:SK_ID_BUREAU d:debt,card_limit",
    lambda s, d: bureau.clean_loans(view(s, d, "bureau")).select(
        "SK_ID_BUREAU", F.col("AMT_CREDIT_SUM_DEBT").alias("debt"), F.col("AMT_CREDIT_SUM_LIMIT").alias("card_limit")),
    """SELECT SK_ID_BUREAU, CASE WHEN AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END AS debt,
       CASE WHEN AMT_CREDIT_SUM_LIMIT < 0 THEN 0 ELSE AMT_CREDIT_SUM_LIMIT END AS card_limit FROM bureau""", ["bureau"])
add("prj_12_masked_measures", "i:SK_ID_CURR d2:active_debt,refused_asked",
    lambda s, d: view(s, d, "previous_application").groupBy("SK_ID_CURR").agg(
        F.sum(nulls.only_if(F.col("NAME_CONTRACT_STATUS") == "Approved", F.col("AMT_CREDIT"))).alias("active_debt"),
        F.avg(nulls.only_if(F.col("NAME_CONTRACT_STATUS") == "Refused", F.col("AMT_APPLICATION"))).alias("refused_asked")),
    """SELECT SK_ID_CURR, sum(AMT_CREDIT) FILTER (NAME_CONTRACT_STATUS = 'Approved') AS active_debt,
       avg(AMT_APPLICATION) FILTER (NAME_CONTRACT_STATUS = 'Refused') AS refused_asked FROM previous_application GROUP BY 1""",
    ["previous_application"])
_KINDS = {"active": "CREDIT_ACTIVE = 'Active'", "sold_or_bad": "CREDIT_ACTIVE IN ('Sold', 'Bad debt')",
          "mortgage": "CREDIT_TYPE = 'Mortgage'", "overdue": "CREDIT_DAY_OVERDUE > 0"}
add("prj_13_flags", "i:SK_ID_BUREAU," + ",".join(_KINDS),
    lambda s, d: view(s, d, "bureau").select("SK_ID_BUREAU", *[nulls.flag(F.expr(e)).alias(n) for n, e in _KINDS.items()]),
    f"SELECT SK_ID_BUREAU, {', '.join(f'{one(e)} AS {n}' for n, e in _KINDS.items())} FROM bureau", ["bureau"])
add("prj_14_status_levels", "s:STATUS i:level,n",
    lambda s, d: view(s, d, "bureau_balance").groupBy("STATUS", F.expr("try_cast(STATUS AS INT)").alias("level"))
    .agg(F.count("*").alias("n")),
    "SELECT STATUS, TRY_CAST(STATUS AS INTEGER) AS level, count(*) AS n FROM bureau_balance GROUP BY 1, 2",
    ["bureau_balance"])
_RUN = """NAME_CONTRACT_STATUS = 'Approved' AND (coalesce(DAYS_TERMINATION = 365243, false) OR coalesce(DAYS_LAST_DUE = 365243, false)
  OR coalesce(DAYS_TERMINATION > 0, false) OR coalesce(DAYS_LAST_DUE > 0, false))"""
add("prj_15_duplicate_filter", "i:all_rows,kept",
    lambda s, d: previous.prepared_applications(view(s, d, "previous_application"), False)
    .agg(F.count("*").alias("all_rows")).transform(
        beside, previous.prepared_applications(view(s, d, "previous_application")).agg(F.count("*").alias("kept"))),
    """SELECT count(*) AS all_rows, count(*) FILTER (FLAG_LAST_APPL_PER_CONTRACT = 'Y' AND NFLAG_LAST_APPL_IN_DAY = 1) AS kept
       FROM previous_application""", ["previous_application"])
add("prj_16_still_running", "i:SK_ID_PREV,running d:end_date",
    lambda s, d: previous.prepared_applications(view(s, d, "previous_application")).select(
        "SK_ID_PREV", "running", F.col("DAYS_TERMINATION").alias("end_date")),
    f"""SELECT SK_ID_PREV, {one(_RUN)} AS running, nullif(DAYS_TERMINATION, 365243) AS end_date FROM previous_application
        WHERE FLAG_LAST_APPL_PER_CONTRACT = 'Y' AND NFLAG_LAST_APPL_IN_DAY = 1""", ["previous_application"])
add("prj_17_recency_window", "i:SK_ID_CURR,recent,months_12,months_6",
    lambda s, d: view(s, d, "pos_cash_balance").groupBy("SK_ID_CURR").agg(
        F.count_if(F.col("MONTHS_BALANCE") >= -3).alias("recent"),
        F.count_if(F.col("MONTHS_BALANCE") >= -12).alias("months_12"),
        F.count_if(F.col("MONTHS_BALANCE") >= -6).alias("months_6")),
    """SELECT SK_ID_CURR, count(*) FILTER (MONTHS_BALANCE >= -3) AS recent, count(*) FILTER (MONTHS_BALANCE >= -12) AS months_12,
       count(*) FILTER (MONTHS_BALANCE >= -6) AS months_6 FROM pos_cash_balance GROUP BY 1""", ["pos_cash_balance"])
add("prj_18_drop_category", "i:SK_ID_CURR", lambda s, d: app(s, d).where(F.col("CODE_GENDER") != "XNA"),
    "SELECT SK_ID_CURR FROM application WHERE CODE_GENDER <> 'XNA'", APP)


def _cross(s, d):
    from lendframe.operators.joins import attach
    a = application.application_features(app(s, d)).select(
        "SK_ID_CURR", "APP_AMT_INCOME_TOTAL", "APP_AMT_ANNUITY", "APP_AMT_CREDIT")
    b = bureau.bureau_features(*loans_with_months(s, d))
    p = previous.previous_features(view(s, d, "previous_application"))
    joined = attach(attach(a, b, bureau.COUNTS, "BUR_HAS_HISTORY"), p, previous.COUNTS, "PREV_HAS_HISTORY")
    return joined.withColumns(feature_table.cross_ratios())


def _cross_sql():
    from lendframe.queries.features import BUR_SQL, PREV_SQL
    return BUR_SQL + "," + PREV_SQL


add("prj_23_cross_ratios", "i:SK_ID_CURR d:BUR_DEBT_TO_INCOME,BUR_ANNUITY_BURDEN,PREV_CURRENT_TO_MEAN_CREDIT", _cross,
    """SELECT a.SK_ID_CURR, BUR_ACTIVE_DEBT_TOTAL / nullif(AMT_INCOME_TOTAL, 0) AS BUR_DEBT_TO_INCOME,
       (coalesce(BUR_ACTIVE_ANNUITY_TOTAL, 0) + AMT_ANNUITY) / nullif(AMT_INCOME_TOTAL, 0) AS BUR_ANNUITY_BURDEN,
       AMT_CREDIT / nullif(PREV_CREDIT_MEAN, 0) AS PREV_CURRENT_TO_MEAN_CREDIT
       FROM application a LEFT JOIN bur USING (SK_ID_CURR) LEFT JOIN prev USING (SK_ID_CURR)""",
    ["application", "bureau", "bureau_balance", "previous_application"], _cross_sql())

# ---------------------------------------------------------------- scalar functions
LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem"""
_X = "(l_quantity - 25) / 10"
add("fn_1_math", "i:l_orderkey,l_linenumber,l_partkey,l_suppkey d:clipped,root,rounded,up,expo",
    lambda s, d: raw(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.least(F.greatest(F.col("l_extendedprice"), F.lit(5000.0)), F.lit(60000.0)).alias("clipped"),
        F.sqrt(F.abs(F.col("l_quantity") - 25)).alias("root"), F.round("l_quantity", -1).alias("rounded"),
        F.ceil(F.col("l_extendedprice") / 1000).alias("up"), F.exp(-F.col("l_discount")).alias("expo")),
    f"""SELECT *, least(greatest(l_extendedprice, 5e3), 6e4) AS clipped, sqrt(abs(l_quantity - 25)) AS root,
        floor(l_quantity / 10 + 0.5) * 10 AS rounded, ceil(l_extendedprice / 1e3) AS up, exp(-l_discount) AS expo FROM ({LINES})""")


def _stable(s, d):
    z = raw(s, d, "lineitem").withColumn("z", (F.col("l_quantity") - 25) * 40)
    return z.groupBy("l_quantity").agg(F.count("*").alias("n"), F.max(stable.sigmoid(F.col("z"))).alias("sigmoid"),
                                       F.max(stable.log_one_plus_exp(F.col("z"))).alias("log_add"))


add("fn_2_stable_math", "d:l_quantity,sigmoid,log_add i:n", _stable,
    """SELECT l_quantity, count(*) AS n, max(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END) AS sigmoid,
       max(greatest(z, 0) + ln(1 + exp(-abs(z)))) AS log_add FROM (SELECT *, (l_quantity - 25) * 40 AS z FROM lineitem) GROUP BY 1""")
_NAMES = ["APP_EXT_MEAN", "BUR_MAX_OVERDUE_EVER", "POS_DPD_MAX", "CC_AVG_CNT_NUM", "INST_AMT_PCT", "c_custkey"]
_WANT = ["External credit scores (average)", "Credit bureau: max overdue ever",
         "POS / cash loans: days past due max", "Credit cards: average count number",
         "Repayment history: amount percent", "c_custkey"]
add("fn_3_feature_label", "i:SK_ID_CURR s:label",
    lambda s, d: app(s, d).select("SK_ID_CURR", text.feature_label(F.element_at(
        F.array(*[F.lit(n) for n in _NAMES]), (F.col("SK_ID_CURR") % 6 + 1).cast("int"))).alias("label")),
    "SELECT SK_ID_CURR, [{}][CAST(SK_ID_CURR % 6 + 1 AS INT)] AS label FROM application".format(
        ", ".join(f"'{w}'" for w in _WANT)), APP)
_FMT = """CASE WHEN {v} IS NULL THEN 'missing' WHEN abs({v}) >= 1000 THEN format('{{:,}}', CAST(floor({v} + 0.5) AS BIGINT))
  WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE format('{{:.3f}}', {v}) END"""
_VAL = "CASE WHEN AMT_ANNUITY > 300 THEN AMT_INCOME_TOTAL + 7e-3 ELSE AMT_ANNUITY + 3e-4 END"
_VAL2 = "CASE WHEN SK_ID_CURR % 3 = 0 THEN CAST(CNT_CHILDREN AS DOUBLE) END"
add("fn_4_format_value", "i:SK_ID_CURR s:money,children",
    lambda s, d: app(s, d).select("SK_ID_CURR", text.format_value(F.expr(_VAL)).alias("money"),
                                  text.format_value(F.expr(_VAL2)).alias("children")),
    f"SELECT SK_ID_CURR, {_FMT.format(v=f'({_VAL})')} AS money, {_FMT.format(v=f'({_VAL2})')} AS children FROM application",
    APP)
add("fn_5_sentences", "i:SK_ID_CURR s:reason,span",
    lambda s, d: app(s, d).select(
        "SK_ID_CURR", text.reason_sentence(F.lit("Family members"), text.format_value(F.col("CNT_CHILDREN"))).alias("reason"),
        text.interval_text(F.col("EXT_SOURCE_2") * 0 + 0.125, F.lit(0.5)).alias("span")),
    """SELECT SK_ID_CURR, 'Family members is ' || CNT_CHILDREN || ', which raised the estimated risk.' AS reason,
       '0.1250 to 0.5000' AS span FROM application""", APP)
add("fn_6_json", "i:event_id,k s:rebuilt",
    lambda s, d: raw(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).withColumn(
        "rebuilt", F.to_json(F.struct("k"))),
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS rebuilt FROM events""")


def _edges(s, d):
    edges = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.floor(i / 2) * 10000.0))
    return raw(s, d, "lineitem").groupBy(bins.bin_index(F.col("l_extendedprice"), edges).alias("bin")).agg(
        F.count("*").alias("n"))


add("fn_7_arrays", "i:bin,n", _edges,
    """SELECT len(list_filter(list_distinct([floor(i / 2e0) * 1e4 for i in range(0, 11)]), lambda e: e <= l_extendedprice)) AS bin,
       count(*) AS n FROM lineitem GROUP BY 1""")
add("fn_8_map_default", "i:event_id,code",
    lambda s, d: raw(s, d, "events").select("event_id", F.coalesce(F.try_element_at(
        F.create_map(F.lit("view"), F.lit(0), F.lit("click"), F.lit(1)), F.col("event_type")), F.lit(-1)).alias("code")),
    "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END AS code FROM events")
add("fn_9_day_offsets", "i:SK_ID_BUREAU,DAYS_CREDIT d:years",
    lambda s, d: view(s, d, "bureau").select("SK_ID_BUREAU", "DAYS_CREDIT", (-F.col("DAYS_CREDIT") / 365.25).alias("years")),
    "SELECT SK_ID_BUREAU, DAYS_CREDIT, -DAYS_CREDIT / 365.25e0 AS years FROM bureau", ["bureau"])
