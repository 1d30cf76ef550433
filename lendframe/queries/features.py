"""Feature pack queries: each table summary and the joined feature table."""

from __future__ import annotations

from lendframe.plans import application, bureau, credit_card, feature_table, installments
from lendframe.plans import pos_cash, previous
from lendframe.plans.adapters import loans_with_months, raw, reader, view
from lendframe.queries.registry import add
from lendframe.session import tasks_for, width


def one(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)"


# ---------------------------------------------------------------- application
_APP_INPUTS = ("CODE_GENDER NAME_CONTRACT_TYPE NAME_EDUCATION_TYPE NAME_INCOME_TYPE NAME_FAMILY_STATUS "
               "OCCUPATION_TYPE ORGANIZATION_TYPE CNT_CHILDREN CNT_FAM_MEMBERS AMT_INCOME_TOTAL AMT_CREDIT "
               "AMT_ANNUITY AMT_GOODS_PRICE EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3 DAYS_BIRTH DAYS_EMPLOYED "
               "DAYS_REGISTRATION DAYS_ID_PUBLISH DAYS_LAST_PHONE_CHANGE OWN_CAR_AGE "
               "REGION_RATING_CLIENT FLAG_MOBIL FLAG_CONT_MOBILE").split()
_APP_INPUTS += application.DOCUMENTS + application.BUREAU_REQUESTS
_REQ = application.BUREAU_REQUESTS
_EXT = application.EXT
_N_EXT = " + ".join(one(f"{c} IS NOT NULL") for c in _EXT)
_S_EXT = " + ".join(f"coalesce({c}, 0e0)" for c in _EXT)
_APP_KEPT = [c for c in _APP_INPUTS
             if c not in application.NEAR_CONSTANT and c not in application.DAY_COLUMNS
             and c != "CODE_GENDER"]
_TEXT = ["NAME_CONTRACT_TYPE", "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "NAME_FAMILY_STATUS",
         "OCCUPATION_TYPE", "ORGANIZATION_TYPE"]
_APP_NUM = [c for c in _APP_KEPT if c not in _TEXT]
APP_SQL = f"""
app_base AS (
  SELECT *, {' + '.join(one(f'{c} IS NULL') for c in _APP_INPUTS)} AS n_missing,
    CASE WHEN DAYS_EMPLOYED <> 365243 THEN -DAYS_EMPLOYED / 365.25e0 END AS emp_years,
    -DAYS_BIRTH / 365.25e0 AS age_years, {_N_EXT} AS n_ext, {_S_EXT} AS s_ext
  FROM application),
app AS (
  SELECT SK_ID_CURR, TARGET, is_test,
    CASE WHEN CODE_GENDER <> 'XNA' THEN CODE_GENDER END AS APP_CODE_GENDER,
    {', '.join(f'{c} AS APP_{c}' for c in _APP_KEPT)},
    {one('DAYS_EMPLOYED = 365243')} AS APP_DAYS_EMPLOYED_ANOM,
    {' + '.join(application.DOCUMENTS)} AS APP_DOC_COUNT,
    CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in _REQ)}
      THEN {' + '.join(f'coalesce({c}, 0)' for c in _REQ)} END AS APP_BUREAU_REQ_TOTAL,
    n_missing AS APP_N_MISSING, age_years AS APP_AGE_YEARS, emp_years AS APP_EMPLOYED_YEARS,
    -DAYS_REGISTRATION / 365.25e0 AS APP_REGISTRATION_YEARS,
    -DAYS_ID_PUBLISH / 365.25e0 AS APP_ID_PUBLISH_YEARS,
    -DAYS_LAST_PHONE_CHANGE / 365.25e0 AS APP_PHONE_CHANGE_YEARS,
    CASE WHEN n_ext > 0 THEN s_ext / n_ext END AS APP_EXT_MEAN,
    least({', '.join(_EXT)}) AS APP_EXT_MIN, greatest({', '.join(_EXT)}) AS APP_EXT_MAX,
    CASE WHEN n_ext > 1 THEN sqrt(({' + '.join(f'coalesce(pow({c} - s_ext / n_ext, 2), 0e0)' for c in _EXT)})
      / (n_ext - 1)) END AS APP_EXT_STD,
    EXT_SOURCE_1 * EXT_SOURCE_2 * EXT_SOURCE_3 AS APP_EXT_PROD, 3 - n_ext AS APP_EXT_NA_COUNT,
    AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0) AS APP_CREDIT_TO_INCOME,
    AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS APP_ANNUITY_TO_INCOME,
    AMT_ANNUITY / nullif(AMT_CREDIT, 0) AS APP_ANNUITY_TO_CREDIT,
    AMT_GOODS_PRICE / nullif(AMT_CREDIT, 0) AS APP_GOODS_TO_CREDIT,
    AMT_CREDIT - AMT_GOODS_PRICE AS APP_CREDIT_MINUS_GOODS,
    AMT_INCOME_TOTAL / nullif(CNT_FAM_MEMBERS, 0) AS APP_INCOME_PER_PERSON,
    CNT_CHILDREN / nullif(CNT_FAM_MEMBERS, 0) AS APP_CHILDREN_RATIO,
    emp_years / nullif(age_years, 0) AS APP_EMPLOYED_TO_AGE,
    CASE WHEN AMT_INCOME_TOTAL > 0 THEN ln(AMT_INCOME_TOTAL) END AS APP_LOG_INCOME
  FROM app_base)"""
_APP_MADE = ["DAYS_EMPLOYED_ANOM", "DOC_COUNT", "BUREAU_REQ_TOTAL", "N_MISSING", "AGE_YEARS",
             "EMPLOYED_YEARS", "REGISTRATION_YEARS", "ID_PUBLISH_YEARS", "PHONE_CHANGE_YEARS",
             "EXT_MEAN", "EXT_MIN", "EXT_MAX", "EXT_STD", "EXT_PROD", "EXT_NA_COUNT",
             "CREDIT_TO_INCOME", "ANNUITY_TO_INCOME", "ANNUITY_TO_CREDIT", "GOODS_TO_CREDIT",
             "CREDIT_MINUS_GOODS", "INCOME_PER_PERSON", "CHILDREN_RATIO", "EMPLOYED_TO_AGE",
             "LOG_INCOME"]
APP_SPEC = ("i:SK_ID_CURR,TARGET,is_test "
            + "s:APP_CODE_GENDER," + ",".join(f"APP_{c}" for c in _TEXT)
            + " d:" + ",".join(f"APP_{c}" for c in _APP_NUM + _APP_MADE))

add("prj_1_9_application_features", APP_SPEC,
    lambda s, d: application.application_features(application.stack_labelled(
        reader(s, d)("application_train"), reader(s, d)("application_test"))),
    "SELECT * FROM app", views=["application"], ctes=APP_SQL)

# ---------------------------------------------------------------- monthly status, bureau
BB_SQL = f"""
bb_rows AS (SELECT *, TRY_CAST(STATUS AS INTEGER) AS level, {one("TRY_CAST(STATUS AS INTEGER) >= 1")} AS late,
    {one("STATUS = 'C'")} AS closed FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL),
bb_last AS (SELECT SK_ID_BUREAU, late, closed FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_BUREAU
    ORDER BY MONTHS_BALANCE DESC, closed DESC, late DESC) AS rn FROM bb_rows) WHERE rn = 1),
bb AS (
  SELECT r.SK_ID_BUREAU, count(*) AS BB_MONTHS, -min(MONTHS_BALANCE) AS BB_HISTORY_MONTHS,
    max(level) AS BB_WORST_STATUS, sum(r.late) AS BB_LATE_MONTHS,
    sum(CASE WHEN MONTHS_BALANCE >= -12 THEN r.late ELSE 0 END) AS BB_LATE_12M,
    {share("STATUS = 'X'")} AS BB_UNKNOWN_SHARE,
    CAST(sum(r.late) AS DOUBLE) / nullif(count(level), 0) AS BB_LATE_SHARE,
    max(l.late) AS BB_LATEST_LATE, max(l.closed) AS BB_LATEST_CLOSED
  FROM bb_rows r JOIN bb_last l USING (SK_ID_BUREAU) GROUP BY 1)"""
BB_SPEC = ("i:SK_ID_BUREAU,BB_MONTHS,BB_HISTORY_MONTHS,BB_WORST_STATUS,BB_LATE_MONTHS,BB_LATE_12M,"
           "BB_LATEST_LATE,BB_LATEST_CLOSED d:BB_UNKNOWN_SHARE,BB_LATE_SHARE")
add("agg_1_monthly_status", BB_SPEC,
    lambda s, d: bureau.monthly_status(view(s, d, "bureau_balance")),
    "SELECT * FROM bb", views=["bureau_balance"], ctes=BB_SQL)

_active = "CREDIT_ACTIVE = 'Active'"
BUR_SQL = BB_SQL + f"""
, loans AS (
  SELECT * REPLACE (
    CASE WHEN DAYS_CREDIT_ENDDATE >= DAYS_CREDIT AND DAYS_CREDIT_ENDDATE <= 18262.5e0
      THEN DAYS_CREDIT_ENDDATE END AS DAYS_CREDIT_ENDDATE,
    CASE WHEN DAYS_ENDDATE_FACT >= DAYS_CREDIT THEN DAYS_ENDDATE_FACT END AS DAYS_ENDDATE_FACT,
    CASE WHEN AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END AS AMT_CREDIT_SUM_DEBT,
    CASE WHEN AMT_CREDIT_SUM_LIMIT < 0 THEN 0 ELSE AMT_CREDIT_SUM_LIMIT END AS AMT_CREDIT_SUM_LIMIT,
    CASE WHEN AMT_CREDIT_SUM_OVERDUE < 0 THEN 0 ELSE AMT_CREDIT_SUM_OVERDUE END AS AMT_CREDIT_SUM_OVERDUE)
  FROM bureau LEFT JOIN bb USING (SK_ID_BUREAU)),
bur AS (
  SELECT SK_ID_CURR, count(*) AS BUR_COUNT, sum({one(_active)}) AS BUR_ACTIVE_COUNT,
    sum({one("CREDIT_ACTIVE = 'Closed'")}) AS BUR_CLOSED_COUNT,
    sum({one("CREDIT_ACTIVE IN ('Sold', 'Bad debt')")}) AS BUR_SOLD_OR_BAD_COUNT,
    sum({one("DAYS_CREDIT >= -365")}) AS BUR_LOANS_LAST_YEAR,
    -min(DAYS_CREDIT) / 365.25e0 AS BUR_OLDEST_LOAN_YEARS,
    -max(DAYS_CREDIT) / 365.25e0 AS BUR_NEWEST_LOAN_YEARS,
    -avg(DAYS_CREDIT) / 365.25e0 AS BUR_MEAN_LOAN_AGE_YEARS,
    max(CASE WHEN {_active} THEN DAYS_CREDIT_ENDDATE END) / 365.25e0 AS BUR_ACTIVE_ENDS_IN_YEARS,
    avg(CASE WHEN CREDIT_ACTIVE = 'Closed' THEN DAYS_ENDDATE_FACT - DAYS_CREDIT END) / 365.25e0
      AS BUR_CLOSED_DURATION_MEAN_YEARS,
    sum(AMT_CREDIT_SUM) AS BUR_CREDIT_TOTAL, max(AMT_CREDIT_SUM) AS BUR_CREDIT_MAX,
    sum(CASE WHEN {_active} THEN AMT_CREDIT_SUM END) AS BUR_ACTIVE_CREDIT_TOTAL,
    sum(CASE WHEN {_active} THEN AMT_CREDIT_SUM_DEBT END) AS BUR_ACTIVE_DEBT_TOTAL,
    sum(CASE WHEN {_active} THEN AMT_ANNUITY END) AS BUR_ACTIVE_ANNUITY_TOTAL,
    sum(AMT_CREDIT_SUM_OVERDUE) AS BUR_OVERDUE_TOTAL,
    max(AMT_CREDIT_MAX_OVERDUE) AS BUR_MAX_OVERDUE_EVER, sum(AMT_CREDIT_SUM_LIMIT) AS BUR_LIMIT_TOTAL,
    max(CREDIT_DAY_OVERDUE) AS BUR_DAYS_OVERDUE_MAX, {share("CREDIT_DAY_OVERDUE > 0")} AS BUR_OVERDUE_NOW_SHARE,
    coalesce(sum(CNT_CREDIT_PROLONG), 0) AS BUR_PROLONG_TOTAL,
    {', '.join(f"sum({one(f'''CREDIT_TYPE = '{k}' ''')}) AS BUR_{v}_COUNT" for k, v in bureau.LOAN_TYPES.items())},
    count(BB_MONTHS) AS BB_LOANS_WITH_HISTORY, max(BB_HISTORY_MONTHS) AS BB_HISTORY_MONTHS_MAX,
    max(BB_WORST_STATUS) AS BB_WORST_STATUS_MAX, sum(BB_LATE_MONTHS) AS BB_LATE_MONTHS_TOTAL,
    sum(BB_LATE_12M) AS BB_LATE_12M_TOTAL, avg(BB_LATE_SHARE) AS BB_LATE_SHARE_MEAN,
    avg(BB_LATEST_LATE) AS BB_LATEST_LATE_SHARE, avg(BB_LATEST_CLOSED) AS BB_LATEST_CLOSED_SHARE,
    avg(BB_UNKNOWN_SHARE) AS BB_UNKNOWN_SHARE_MEAN,
    sum(CASE WHEN {_active} THEN AMT_CREDIT_SUM_DEBT END)
      / nullif(sum(CASE WHEN {_active} THEN AMT_CREDIT_SUM END), 0) AS BUR_DEBT_RATIO_ACTIVE,
    CAST(max(DAYS_CREDIT) - min(DAYS_CREDIT) AS DOUBLE) / nullif(count(*) - 1, 0) AS BUR_AVG_GAP_DAYS
  FROM loans WHERE SK_ID_CURR IS NOT NULL GROUP BY 1)"""
BUR_INT = bureau.COUNTS + ["BUR_DAYS_OVERDUE_MAX", "BB_HISTORY_MONTHS_MAX", "BB_WORST_STATUS_MAX",
                           "BB_LATE_MONTHS_TOTAL", "BB_LATE_12M_TOTAL"]
BUR_MONEY = ["BUR_CREDIT_TOTAL", "BUR_CREDIT_MAX", "BUR_ACTIVE_CREDIT_TOTAL", "BUR_ACTIVE_DEBT_TOTAL",
             "BUR_ACTIVE_ANNUITY_TOTAL", "BUR_OVERDUE_TOTAL", "BUR_MAX_OVERDUE_EVER", "BUR_LIMIT_TOTAL"]
BUR_NUM = ["BUR_OLDEST_LOAN_YEARS", "BUR_NEWEST_LOAN_YEARS", "BUR_MEAN_LOAN_AGE_YEARS",
           "BUR_ACTIVE_ENDS_IN_YEARS", "BUR_CLOSED_DURATION_MEAN_YEARS", "BUR_OVERDUE_NOW_SHARE",
           "BB_LATE_SHARE_MEAN", "BB_LATEST_LATE_SHARE", "BB_LATEST_CLOSED_SHARE",
           "BB_UNKNOWN_SHARE_MEAN", "BUR_DEBT_RATIO_ACTIVE", "BUR_AVG_GAP_DAYS"]
BUR_SPEC = f"i:SK_ID_CURR,{','.join(BUR_INT)} d2:{','.join(BUR_MONEY)} d:{','.join(BUR_NUM)}"
add("agg_2_bureau", BUR_SPEC,
    lambda s, d: bureau.bureau_features(*loans_with_months(s, d)),
    "SELECT * FROM bur", views=["bureau", "bureau_balance"], ctes=BUR_SQL)

# ---------------------------------------------------------------- previous applications
_ap, _re = "approved = 1", "refused = 1"
PREV_SQL = f"""
prev_rows AS (
  SELECT *, {one("NAME_CONTRACT_STATUS = 'Approved'")} AS approved,
    {one("NAME_CONTRACT_STATUS = 'Refused'")} AS refused, {one("NAME_CONTRACT_TYPE = 'Cash loans'")} AS cash,
    {one("NAME_CONTRACT_STATUS = 'Approved' AND (coalesce(DAYS_TERMINATION = 365243, false) OR coalesce(DAYS_LAST_DUE = 365243, false) OR coalesce(DAYS_TERMINATION > 0, false) OR coalesce(DAYS_LAST_DUE > 0, false))")} AS running,
    AMT_APPLICATION / nullif(AMT_CREDIT, 0) AS ask
  FROM previous_application
  WHERE FLAG_LAST_APPL_PER_CONTRACT = 'Y' AND NFLAG_LAST_APPL_IN_DAY = 1 AND SK_ID_CURR IS NOT NULL),
prev_last AS (SELECT SK_ID_CURR, refused, cash FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR
    ORDER BY DAYS_DECISION DESC, SK_ID_PREV DESC) AS rn FROM prev_rows) WHERE rn = 1),
prev AS (
  SELECT r.SK_ID_CURR, count(*) AS PREV_COUNT, sum(approved) AS PREV_APPROVED_COUNT,
    sum(r.refused) AS PREV_REFUSED_COUNT, sum({one("NAME_CONTRACT_STATUS = 'Canceled'")}) AS PREV_CANCELED_COUNT,
    sum({one("NAME_CONTRACT_STATUS = 'Unused offer'")}) AS PREV_UNUSED_COUNT,
    sum({one("DAYS_DECISION >= -365")}) AS PREV_APPS_LAST_YEAR,
    avg(approved) AS PREV_APPROVED_SHARE, avg(r.refused) AS PREV_REFUSED_SHARE,
    -max(DAYS_DECISION) / 365.25e0 AS PREV_YEARS_SINCE_LAST,
    -min(DAYS_DECISION) / 365.25e0 AS PREV_YEARS_SINCE_FIRST,
    -max(CASE WHEN r.{_re} THEN DAYS_DECISION END) / 365.25e0 AS PREV_YEARS_SINCE_LAST_REFUSAL,
    avg(CASE WHEN {_ap} THEN ask END) AS PREV_ASK_TO_GIVEN_MEAN,
    max(CASE WHEN {_ap} THEN ask END) AS PREV_ASK_TO_GIVEN_MAX,
    avg(CASE WHEN {_ap} THEN AMT_GOODS_PRICE / nullif(AMT_CREDIT, 0) END) AS PREV_GOODS_TO_CREDIT_MEAN,
    avg(CASE WHEN {_ap} THEN AMT_ANNUITY * CNT_PAYMENT / nullif(AMT_CREDIT, 0) - 1 END) AS PREV_TOTAL_COST_MEAN,
    avg(CASE WHEN {_ap} THEN AMT_CREDIT END) AS PREV_CREDIT_MEAN,
    max(CASE WHEN {_ap} THEN AMT_CREDIT END) AS PREV_CREDIT_MAX,
    avg(CASE WHEN {_ap} THEN AMT_ANNUITY END) AS PREV_ANNUITY_MEAN,
    avg(CASE WHEN {_ap} THEN CNT_PAYMENT END) AS PREV_TERM_MEAN,
    avg(CASE WHEN r.{_re} THEN AMT_APPLICATION END) AS PREV_REFUSED_ASKED_MEAN,
    avg(RATE_DOWN_PAYMENT) AS PREV_DOWN_PAYMENT_RATE_MEAN,
    {share("NAME_YIELD_GROUP = 'high'")} AS PREV_HIGH_YIELD_SHARE,
    {share("NAME_PRODUCT_TYPE = 'x-sell'")} AS PREV_XSELL_SHARE,
    {share("NAME_CONTRACT_TYPE = 'Cash loans'")} AS PREV_CASH_SHARE,
    {share("NAME_CONTRACT_TYPE = 'Consumer loans'")} AS PREV_CONSUMER_SHARE,
    {share("NAME_CONTRACT_TYPE = 'Revolving loans'")} AS PREV_REVOLVING_SHARE,
    sum(running) AS PREV_RUNNING_COUNT,
    sum(CASE WHEN running = 1 THEN AMT_CREDIT END) AS PREV_RUNNING_CREDIT_TOTAL,
    max(l.refused) AS PREV_LAST_REFUSED, max(l.cash) AS PREV_LAST_CASH
  FROM prev_rows r JOIN prev_last l USING (SK_ID_CURR) GROUP BY 1)"""
PREV_INT = previous.COUNTS + ["PREV_LAST_REFUSED", "PREV_LAST_CASH"]
PREV_MONEY = ["PREV_CREDIT_MEAN", "PREV_CREDIT_MAX", "PREV_ANNUITY_MEAN", "PREV_REFUSED_ASKED_MEAN",
              "PREV_RUNNING_CREDIT_TOTAL"]
PREV_NUM = ["PREV_APPROVED_SHARE", "PREV_REFUSED_SHARE", "PREV_YEARS_SINCE_LAST", "PREV_YEARS_SINCE_FIRST",
            "PREV_YEARS_SINCE_LAST_REFUSAL", "PREV_ASK_TO_GIVEN_MEAN", "PREV_ASK_TO_GIVEN_MAX",
            "PREV_GOODS_TO_CREDIT_MEAN", "PREV_TOTAL_COST_MEAN", "PREV_TERM_MEAN",
            "PREV_DOWN_PAYMENT_RATE_MEAN", "PREV_HIGH_YIELD_SHARE", "PREV_XSELL_SHARE", "PREV_CASH_SHARE",
            "PREV_CONSUMER_SHARE", "PREV_REVOLVING_SHARE"]
PREV_SPEC = f"i:SK_ID_CURR,{','.join(PREV_INT)} d2:{','.join(PREV_MONEY)} d:{','.join(PREV_NUM)}"
add("agg_3_previous", PREV_SPEC,
    lambda s, d: previous.previous_features(view(s, d, "previous_application")),
    "SELECT * FROM prev", views=["previous_application"], ctes=PREV_SQL)

# ---------------------------------------------------------------- installments
PER_SQL = f"""
per0 AS (
  SELECT SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, max(AMT_INSTALMENT) AS due,
    coalesce(sum(AMT_PAYMENT), 0) AS paid, max(DAYS_INSTALMENT) AS due_day,
    max(DAYS_ENTRY_PAYMENT) AS last_pay, count(*) AS parts
  FROM installments_payments GROUP BY 1, 2, 3),
per AS (
  SELECT *, CASE WHEN last_pay - due_day < 0 THEN 0 ELSE last_pay - due_day END AS dpd,
    CASE WHEN due_day - last_pay < 0 THEN 0 ELSE due_day - last_pay END AS dbd,
    {one("last_pay - due_day > 0")} AS late, {one("last_pay IS NULL")} AS missed,
    CASE WHEN due > 0 THEN paid / due END AS paid_ratio,
    CASE WHEN due - paid < 0 THEN 0 ELSE due - paid END AS underpaid,
    {one("due_day >= -365")} AS recent FROM per0)"""
PER_SPEC = ("i:SK_ID_CURR,SK_ID_PREV,NUM_INSTALMENT_NUMBER,parts,late,missed,recent "
            "d2:due,paid,underpaid d:due_day,last_pay,dpd,dbd,paid_ratio")
add("agg_4_per_installment", PER_SPEC,
    lambda s, d: installments.per_installment(view(s, d, "installments_payments")),
    "SELECT * FROM per", views=["installments_payments"], ctes=PER_SQL)
INST_SQL = PER_SQL + f"""
, versions AS (SELECT SK_ID_PREV, count(DISTINCT NUM_INSTALMENT_VERSION) - 1 AS changes
  FROM installments_payments GROUP BY 1),
inst_loans AS (SELECT SK_ID_CURR, SK_ID_PREV, avg(late) AS late_share, max(dpd) AS dpd_max
  FROM per GROUP BY 1, 2),
inst_l AS (SELECT SK_ID_CURR, count(*) AS INST_LOANS, avg(late_share) AS INST_LOAN_LATE_SHARE_MEAN,
  avg(dpd_max) AS INST_LOAN_DPD_MAX_MEAN, max(changes) AS INST_VERSION_CHANGES_MAX
  FROM inst_loans JOIN versions USING (SK_ID_PREV) GROUP BY 1),
inst_p AS (
  SELECT SK_ID_CURR, count(*) AS INST_COUNT, avg(late) AS INST_LATE_SHARE, avg(dpd) AS INST_DPD_MEAN,
    max(dpd) AS INST_DPD_MAX, avg(dbd) AS INST_DBD_MEAN, avg(paid_ratio) AS INST_PAID_RATIO_MEAN,
    min(paid_ratio) AS INST_PAID_RATIO_MIN, coalesce(sum(underpaid), 0) AS INST_UNDERPAID_TOTAL,
    max(underpaid) AS INST_UNDERPAID_MAX, sum(missed) AS INST_MISSED_COUNT,
    {share("parts > 1")} AS INST_SPLIT_PAYMENTS_SHARE FROM per GROUP BY 1),
inst_r AS (
  SELECT SK_ID_CURR, count(*) AS INST_12M_COUNT, avg(late) AS INST_12M_LATE_SHARE,
    avg(dpd) AS INST_12M_DPD_MEAN, max(dpd) AS INST_12M_DPD_MAX,
    avg(paid_ratio) AS INST_12M_PAID_RATIO_MEAN, coalesce(sum(underpaid), 0) AS INST_12M_UNDERPAID_TOTAL
  FROM per WHERE recent = 1 GROUP BY 1),
inst AS (
  SELECT * REPLACE (coalesce(INST_12M_COUNT, 0) AS INST_12M_COUNT)
  FROM inst_p JOIN inst_l USING (SK_ID_CURR) LEFT JOIN inst_r USING (SK_ID_CURR))"""
INST_INT = installments.COUNTS + ["INST_VERSION_CHANGES_MAX"]
INST_MONEY = ["INST_UNDERPAID_TOTAL", "INST_UNDERPAID_MAX", "INST_12M_UNDERPAID_TOTAL"]
INST_NUM = ["INST_LATE_SHARE", "INST_DPD_MEAN", "INST_DPD_MAX", "INST_DBD_MEAN", "INST_PAID_RATIO_MEAN",
            "INST_PAID_RATIO_MIN", "INST_SPLIT_PAYMENTS_SHARE", "INST_LOAN_LATE_SHARE_MEAN",
            "INST_LOAN_DPD_MAX_MEAN", "INST_12M_LATE_SHARE", "INST_12M_DPD_MEAN", "INST_12M_DPD_MAX",
            "INST_12M_PAID_RATIO_MEAN"]
INST_SPEC = f"i:SK_ID_CURR,{','.join(INST_INT)} d2:{','.join(INST_MONEY)} d:{','.join(INST_NUM)}"
add("agg_5_installments", INST_SPEC,
    lambda s, d: installments.installment_features(view(s, d, "installments_payments")),
    "SELECT * FROM inst", views=["installments_payments"], ctes=INST_SQL)

# ---------------------------------------------------------------- POS and cards
POS_SQL = f"""
pos_last AS (SELECT SK_ID_CURR, SK_ID_PREV, CNT_INSTALMENT_FUTURE AS future,
    {one("NAME_CONTRACT_STATUS = 'Active'")} AS active FROM (SELECT *, row_number() OVER (
    PARTITION BY SK_ID_CURR, SK_ID_PREV ORDER BY MONTHS_BALANCE DESC, CNT_INSTALMENT_FUTURE DESC NULLS LAST,
    NAME_CONTRACT_STATUS DESC) AS rn FROM pos_cash_balance) WHERE rn = 1),
pos_loans AS (
  SELECT SK_ID_CURR, SK_ID_PREV, count(*) AS months, max(SK_DPD) AS dpd_max, max(SK_DPD_DEF) AS dpd_def,
    {share("SK_DPD > 0")} AS dpd_share, max(CASE WHEN MONTHS_BALANCE >= -12 THEN SK_DPD END) AS dpd_12m,
    max({one("NAME_CONTRACT_STATUS = 'Completed'")}) AS completed,
    max({one("NAME_CONTRACT_STATUS = 'Demand'")}) AS demand,
    greatest(count(DISTINCT CNT_INSTALMENT) - 1, 0) AS changes FROM pos_cash_balance GROUP BY 1, 2),
pos AS (
  SELECT SK_ID_CURR, count(*) AS POS_LOANS, avg(months) AS POS_MONTHS_MEAN, max(dpd_max) AS POS_DPD_MAX,
    max(dpd_def) AS POS_DPD_DEF_MAX, avg(dpd_share) AS POS_DPD_SHARE_MEAN, max(dpd_12m) AS POS_12M_DPD_MAX,
    avg(completed) AS POS_COMPLETED_SHARE, sum(demand) AS POS_DEMAND_COUNT,
    sum(changes) AS POS_TERM_CHANGES_TOTAL, sum(active) AS POS_ACTIVE_LOANS,
    sum(future) AS POS_FUTURE_INSTALLMENTS_TOTAL
  FROM pos_loans JOIN pos_last USING (SK_ID_CURR, SK_ID_PREV) GROUP BY 1)"""
POS_INT = pos_cash.COUNTS + ["POS_DPD_MAX", "POS_DPD_DEF_MAX", "POS_12M_DPD_MAX"]
POS_NUM = ["POS_MONTHS_MEAN", "POS_DPD_SHARE_MEAN", "POS_COMPLETED_SHARE", "POS_FUTURE_INSTALLMENTS_TOTAL"]
POS_SPEC = f"i:SK_ID_CURR,{','.join(POS_INT)} d:{','.join(POS_NUM)}"
add("agg_6_pos", POS_SPEC, lambda s, d: pos_cash.pos_features(view(s, d, "pos_cash_balance")),
    "SELECT * FROM pos", views=["pos_cash_balance"], ctes=POS_SQL)

CC_SQL = f"""
cc_rows AS (
  SELECT *, AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0) AS util,
    AMT_PAYMENT_CURRENT / nullif(AMT_INST_MIN_REGULARITY, 0) AS pay_to_min,
    CASE WHEN AMT_INST_MIN_REGULARITY > 0
      THEN {one("coalesce(AMT_PAYMENT_CURRENT, 0) < AMT_INST_MIN_REGULARITY")} END AS below_min,
    CASE WHEN AMT_DRAWINGS_CURRENT < 0 THEN 0 ELSE AMT_DRAWINGS_CURRENT END AS drawn,
    CASE WHEN AMT_DRAWINGS_ATM_CURRENT < 0 THEN 0 ELSE AMT_DRAWINGS_ATM_CURRENT END AS atm
  FROM credit_card_balance),
cc_last AS (SELECT SK_ID_CURR, SK_ID_PREV, util AS util_latest FROM (SELECT *, row_number() OVER (
    PARTITION BY SK_ID_CURR, SK_ID_PREV ORDER BY MONTHS_BALANCE DESC, AMT_BALANCE DESC,
    AMT_CREDIT_LIMIT_ACTUAL DESC) AS rn FROM cc_rows) WHERE rn = 1),
cc_cards AS (
  SELECT SK_ID_CURR, SK_ID_PREV, count(*) AS months, avg(util) AS util, max(util) AS util_max,
    avg(CASE WHEN MONTHS_BALANCE >= -6 THEN util END) AS util_6m, avg(below_min) AS below_min,
    avg(pay_to_min) AS pay_to_min, avg(CASE WHEN drawn > 0 THEN atm / drawn END) AS cash_share,
    max(SK_DPD) AS dpd_max, sum({one("SK_DPD > 0")}) AS dpd_months,
    greatest(count(DISTINCT AMT_CREDIT_LIMIT_ACTUAL) - 1, 0) AS changes, coalesce(sum(drawn), 0) AS drawn
  FROM cc_rows GROUP BY 1, 2),
cc AS (
  SELECT SK_ID_CURR, count(*) AS CC_CARDS, avg(months) AS CC_MONTHS_MEAN, avg(util) AS CC_UTIL_MEAN,
    max(util_max) AS CC_UTIL_MAX, avg(util_latest) AS CC_UTIL_LATEST_MEAN, avg(util_6m) AS CC_UTIL_6M_MEAN,
    avg(below_min) AS CC_BELOW_MIN_SHARE_MEAN, avg(pay_to_min) AS CC_PAY_TO_MIN_MEAN,
    avg(cash_share) AS CC_CASH_SHARE_MEAN, max(dpd_max) AS CC_DPD_MAX,
    sum(dpd_months) AS CC_DPD_MONTHS_TOTAL, sum(changes) AS CC_LIMIT_CHANGES_TOTAL,
    sum(drawn) AS CC_DRAWN_TOTAL
  FROM cc_cards JOIN cc_last USING (SK_ID_CURR, SK_ID_PREV) GROUP BY 1)"""
CC_INT = credit_card.COUNTS + ["CC_DPD_MAX"]
CC_NUM = ["CC_MONTHS_MEAN", "CC_UTIL_MEAN", "CC_UTIL_MAX", "CC_UTIL_LATEST_MEAN", "CC_UTIL_6M_MEAN",
          "CC_BELOW_MIN_SHARE_MEAN", "CC_PAY_TO_MIN_MEAN", "CC_CASH_SHARE_MEAN"]
CC_SPEC = f"i:SK_ID_CURR,{','.join(CC_INT)} d2:CC_DRAWN_TOTAL d:{','.join(CC_NUM)}"
add("agg_7_credit_card", CC_SPEC, lambda s, d: credit_card.card_features(view(s, d, "credit_card_balance")),
    "SELECT * FROM cc", views=["credit_card_balance"], ctes=CC_SQL)

# ---------------------------------------------------------------- joined feature table
ALL_VIEWS = ["application", "bureau", "bureau_balance", "previous_application", "installments_payments",
             "pos_cash_balance", "credit_card_balance"]
_COUNTS = bureau.COUNTS + previous.COUNTS + installments.COUNTS + pos_cash.COUNTS + credit_card.COUNTS
FEATURES_SQL = ",".join(s.strip().strip(",") for s in
                        (APP_SQL, BUR_SQL, PREV_SQL, INST_SQL, POS_SQL, CC_SQL)) + f"""
, features AS (
  SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in _COUNTS)}),
    {', '.join(f'{one(f"{t}.SK_ID_CURR IS NOT NULL")} AS {t.upper()}_HAS_HISTORY'
               for t in ("bur", "prev", "inst", "pos", "cc"))},
    BUR_ACTIVE_DEBT_TOTAL / nullif(APP_AMT_INCOME_TOTAL, 0) AS BUR_DEBT_TO_INCOME,
    (coalesce(BUR_ACTIVE_ANNUITY_TOTAL, 0) + APP_AMT_ANNUITY) / nullif(APP_AMT_INCOME_TOTAL, 0)
      AS BUR_ANNUITY_BURDEN,
    APP_AMT_CREDIT / nullif(PREV_CREDIT_MEAN, 0) AS PREV_CURRENT_TO_MEAN_CREDIT
  FROM app LEFT JOIN bur USING (SK_ID_CURR) LEFT JOIN prev USING (SK_ID_CURR)
  LEFT JOIN inst USING (SK_ID_CURR) LEFT JOIN pos USING (SK_ID_CURR) LEFT JOIN cc USING (SK_ID_CURR))"""


def _without_key(spec: str) -> str:
    return spec.replace("i:SK_ID_CURR,", "i:", 1)


FEATURES_SPEC = " ".join([APP_SPEC, *[_without_key(x) for x in
                                      (BUR_SPEC, PREV_SPEC, INST_SPEC, POS_SPEC, CC_SPEC)],
                          "i:BUR_HAS_HISTORY,PREV_HAS_HISTORY,INST_HAS_HISTORY,POS_HAS_HISTORY,CC_HAS_HISTORY",
                          "d:BUR_DEBT_TO_INCOME,BUR_ANNUITY_BURDEN,PREV_CURRENT_TO_MEAN_CREDIT"])


#: Applicants whose summaries one task joins.
JOINED_A_TASK = 20_000


def by_applicant(spark, sf_dir):
    """Deals rows out by the applicant where a task of a plain shuffle would hold too many of them."""
    n = tasks_for(raw(spark, sf_dir, "customer"), JOINED_A_TASK)
    return lambda df: df.repartition(n, "SK_ID_CURR") if n > width(spark) else df


def features(spark, sf_dir):
    return feature_table.feature_table(reader(spark, sf_dir), by_applicant(spark, sf_dir))


add("agg_8_feature_table", FEATURES_SPEC, features, "SELECT * FROM features", views=ALL_VIEWS,
    ctes=FEATURES_SQL)


def previous_attached(spark, sf_dir):
    """Flagship slice: previous-application features on the applicant table."""
    from lendframe.operators.joins import attach
    base = view(spark, sf_dir, "application").select("SK_ID_CURR", "TARGET", "is_test")
    return attach(base, previous.previous_features(view(spark, sf_dir, "previous_application")),
                  previous.COUNTS, "PREV_HAS_HISTORY")


add("jn_1_attach_previous", "i:TARGET,is_test,PREV_HAS_HISTORY " + PREV_SPEC, previous_attached,
    f"""SELECT a.SK_ID_CURR, a.TARGET, a.is_test, {one('prev.SK_ID_CURR IS NOT NULL')} AS PREV_HAS_HISTORY,
        prev.* EXCLUDE (SK_ID_CURR) REPLACE ({', '.join(f'coalesce(prev.{c}, 0) AS {c}' for c in previous.COUNTS)})
        FROM application a LEFT JOIN prev ON prev.SK_ID_CURR = a.SK_ID_CURR""",
    views=["application", "previous_application"], ctes=PREV_SQL)


def ablation_columns(spark, sf_dir):
    """Features of two source tables only, as an ablation step would train on."""
    df = features(spark, sf_dir)
    return df.select("SK_ID_CURR", *feature_table.family_columns(df.columns, ["PREV_", "CC_"]))


add("prj_22_family_columns", " ".join([PREV_SPEC, _without_key(CC_SPEC), "i:PREV_HAS_HISTORY,CC_HAS_HISTORY",
                                       "d:PREV_CURRENT_TO_MEAN_CREDIT"]), ablation_columns,
    "SELECT * FROM features", views=ALL_VIEWS, ctes=FEATURES_SQL)
_HISTORY = [c for spec in (BUR_SPEC, PREV_SPEC, INST_SPEC, POS_SPEC, CC_SPEC)
            for part in spec.split() for c in part.split(":")[1].split(",") if c != "SK_ID_CURR"]


def family_totals(spark, sf_dir):
    """Columns, filled cells and positive cells of each source table."""
    from pyspark.sql import functions as F
    from lendframe.functions.text import family_of
    from lendframe.operators.reshape import to_long
    long = to_long(features(spark, sf_dir), _HISTORY)
    per = long.groupBy("column").agg(F.count("value").alias("filled"),
                                     F.count_if(F.col("value") > 1e-9).alias("positive"))
    return per.groupBy(family_of(F.col("column")).alias("family")).agg(
        F.count("*").alias("columns"), F.sum("filled").alias("filled"), F.sum("positive").alias("positive"))


def _family_sql() -> str:
    from lendframe.functions.text import FAMILIES
    parts = []
    for prefix, name in FAMILIES.items():
        cols = [c for c in _HISTORY if c.startswith(prefix)]
        if cols:
            parts.append(f"""SELECT '{name}' AS family, {len(cols)} AS columns, {' + '.join(f'count({c})' for c in cols)} AS filled,
              {' + '.join(f'count(*) FILTER ({c} > 1e-9)' for c in cols)} AS positive FROM features""")
    return " UNION ALL ".join(parts)


add("agg_14_family_totals", "s:family i:columns,filled,positive", family_totals, _family_sql(),
    views=ALL_VIEWS, ctes=FEATURES_SQL)
