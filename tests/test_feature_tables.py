"""Hand-worked mini tables for every table summary."""

import math

import pytest
from pyspark.sql import functions as F

from lendframe.operators.joins import assert_unique, attach
from lendframe.plans import application, bureau, credit_card, installments, pos_cash, previous

YEAR = 365.25


def by_key(df, key="SK_ID_CURR"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame([
        (1, 10, "Active", "Consumer credit", -100, 0, 500.0, None, None, 0, 1000.0, 500.0, 0.0, 0.0, 50.0),
        (1, 11, "Closed", "Credit card", -800, 0, -400.0, -400.0, 0.0, 1, 2000.0, 0.0, 300.0, 0.0, None),
        (2, 12, "Sold", "Mortgage", -3000, 30, -5000.0, None, 100.0, 0, 5000.0, -10.0, None, 50.0, None),
    ], "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT int,"
       "CREDIT_DAY_OVERDUE int, DAYS_CREDIT_ENDDATE double, DAYS_ENDDATE_FACT double, AMT_CREDIT_MAX_OVERDUE double,"
       "CNT_CREDIT_PROLONG int, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_LIMIT double,"
       "AMT_CREDIT_SUM_OVERDUE double, AMT_ANNUITY double")


@pytest.fixture(scope="module")
def months(spark):
    return spark.createDataFrame([(10, 0, "C"), (10, -1, "1"), (10, -2, "0"), (11, -1, "X"), (11, -20, "5")],
                                 "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")


def test_monthly_status(months):
    got = by_key(bureau.monthly_status(months), "SK_ID_BUREAU")
    a, b = got[10], got[11]
    assert (a["BB_MONTHS"], a["BB_HISTORY_MONTHS"], a["BB_WORST_STATUS"], a["BB_LATE_SHARE"]) == (3, 2, 1, 0.5)
    assert a["BB_LATEST_CLOSED"] == 1 and a["BB_LATE_12M"] == 1
    assert (b["BB_WORST_STATUS"], b["BB_LATE_SHARE"], b["BB_LATE_12M"], b["BB_LATEST_CLOSED"]) == (5, 1.0, 0, 0)
    assert b["BB_UNKNOWN_SHARE"] == 0.5


def test_bureau(loans, months):
    got = by_key(bureau.bureau_features(loans, months))
    a, b = got[1], got[2]
    assert (a["BUR_COUNT"], a["BUR_ACTIVE_COUNT"], a["BUR_CLOSED_COUNT"], a["BUR_LOANS_LAST_YEAR"]) == (2, 1, 1, 1)
    assert a["BUR_DEBT_RATIO_ACTIVE"] == 0.5 and a["BUR_AVG_GAP_DAYS"] == 700 and a["BUR_CONSUMER_COUNT"] == 1
    assert a["BUR_CLOSED_DURATION_MEAN_YEARS"] == pytest.approx(400 / YEAR)
    assert a["BUR_ACTIVE_ENDS_IN_YEARS"] == pytest.approx(500 / YEAR)
    assert (a["BB_LOANS_WITH_HISTORY"], a["BB_WORST_STATUS_MAX"]) == (2, 5)
    assert a["BB_LATE_SHARE_MEAN"] == 0.75 and a["BB_LATEST_CLOSED_SHARE"] == 0.5
    assert b["BUR_SOLD_OR_BAD_COUNT"] == 1 and b["BUR_AVG_GAP_DAYS"] is None and b["BUR_DAYS_OVERDUE_MAX"] == 30
    assert b["BUR_OVERDUE_NOW_SHARE"] == 1 and b["BUR_MORTGAGE_COUNT"] == 1 and b["BB_LOANS_WITH_HISTORY"] == 0


def test_previous(spark):
    rows = [
        (1, 1, "Cash loans", "Approved", 1000.0, 800.0, 100.0, 800.0, .1, 10.0, "middle", -200, "walk-in", "Y", 1, 365243.0, -170.0, 100.0, 100.0, 365243.0),
        (2, 1, "Consumer loans", "Refused", 500.0, 0.0, None, 500.0, None, 12.0, "high", -50, "x-sell", "Y", 1, None, None, None, None, None),
        (3, 1, "Cash loans", "Approved", 999.0, 999.0, 10.0, None, 0.0, 12.0, "middle", -60, "walk-in", "N", 1, None, None, None, None, None),
        (4, 2, "Revolving loans", "Approved", 300.0, 300.0, 30.0, None, None, 0.0, "high", -1000, "x-sell", "Y", 1, 365243.0, -990.0, 365243.0, -10.0, 365243.0),
        (5, 3, "Revolving loans", "Approved", 300.0, 300.0, 30.0, None, None, 0.0, "high", -1000, "x-sell", "Y", 1, 365243.0, -990.0, 365243.0, -120.0, -100.0),
    ]
    df = spark.createDataFrame(rows, (
        "SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_TYPE string, NAME_CONTRACT_STATUS string, AMT_APPLICATION double,"
        "AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, RATE_DOWN_PAYMENT double, CNT_PAYMENT double,"
        "NAME_YIELD_GROUP string, DAYS_DECISION int, NAME_PRODUCT_TYPE string, FLAG_LAST_APPL_PER_CONTRACT string,"
        "NFLAG_LAST_APPL_IN_DAY int, DAYS_FIRST_DRAWING double, DAYS_FIRST_DUE double, DAYS_LAST_DUE_1ST_VERSION double,"
        "DAYS_LAST_DUE double, DAYS_TERMINATION double"))
    got = by_key(previous.previous_features(df))
    a, b, c = got[1], got[2], got[3]
    assert a["PREV_COUNT"] == 2 and a["PREV_REFUSED_SHARE"] == 0.5 and a["PREV_ASK_TO_GIVEN_MEAN"] == 1.25
    assert a["PREV_TOTAL_COST_MEAN"] == pytest.approx(0.25) and a["PREV_RUNNING_COUNT"] == 1
    assert a["PREV_LAST_REFUSED"] == 1 and a["PREV_YEARS_SINCE_LAST"] == pytest.approx(50 / YEAR)
    assert b["PREV_RUNNING_COUNT"] == 1 and b["PREV_HIGH_YIELD_SHARE"] == 1 and b["PREV_REVOLVING_SHARE"] == 1
    assert c["PREV_RUNNING_COUNT"] == 0 and c["PREV_RUNNING_CREDIT_TOTAL"] is None
    assert by_key(previous.previous_features(df, drop_duplicates=False))[1]["PREV_COUNT"] == 3


def test_installments(spark):
    df = spark.createDataFrame([
        (1, 1, 1.0, 1, -60.0, -62.0, 1000.0, 500.0), (1, 1, 1.0, 1, -60.0, -55.0, 1000.0, 500.0),
        (1, 1, 2.0, 2, -30.0, -31.0, 1000.0, 1000.0), (2, 1, 1.0, 1, -400.0, None, 200.0, None),
        (3, 2, 1.0, 1, -10.0, -5.0, 300.0, 100.0)],
        "SK_ID_PREV long, SK_ID_CURR long, NUM_INSTALMENT_VERSION double, NUM_INSTALMENT_NUMBER int,"
        "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double")
    got = by_key(installments.installment_features(df))
    a, b = got[1], got[2]
    assert (a["INST_COUNT"], a["INST_UNDERPAID_TOTAL"], a["INST_DPD_MAX"], a["INST_MISSED_COUNT"]) == (3, 200, 5, 1)
    assert a["INST_LATE_SHARE"] == pytest.approx(1 / 3) and a["INST_SPLIT_PAYMENTS_SHARE"] == pytest.approx(1 / 3)
    assert (a["INST_PAID_RATIO_MIN"], a["INST_LOANS"], a["INST_VERSION_CHANGES_MAX"]) == (0, 2, 1)
    assert a["INST_12M_COUNT"] == 2 and a["INST_12M_LATE_SHARE"] == 0.5
    assert b["INST_UNDERPAID_TOTAL"] == 200 and b["INST_PAID_RATIO_MEAN"] == pytest.approx(1 / 3)


def test_pos(spark):
    df = spark.createDataFrame([
        (1, 1, -3, 12.0, 2.0, "Active", 0, 0), (1, 1, -2, 12.0, 1.0, "Active", 10, 10),
        (1, 1, -1, 12.0, 0.0, "Completed", 0, 0), (2, 1, -20, 6.0, 5.0, "Demand", 0, 0),
        (2, 1, -1, 8.0, 3.0, "Active", 0, 0), (3, 2, -1, None, None, "Active", 0, 0)],
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double,"
        "NAME_CONTRACT_STATUS string, SK_DPD int, SK_DPD_DEF int")
    got = by_key(pos_cash.pos_features(df))
    a = got[1]
    assert (a["POS_LOANS"], a["POS_DPD_MAX"], a["POS_12M_DPD_MAX"], a["POS_COMPLETED_SHARE"]) == (2, 10, 10, 0.5)
    assert (a["POS_DEMAND_COUNT"], a["POS_TERM_CHANGES_TOTAL"], a["POS_ACTIVE_LOANS"]) == (1, 1, 1)
    assert a["POS_FUTURE_INSTALLMENTS_TOTAL"] == 3 and a["POS_DPD_SHARE_MEAN"] == pytest.approx(1 / 6)
    assert got[2]["POS_TERM_CHANGES_TOTAL"] == 0


def test_cards(spark):
    df = spark.createDataFrame([
        (1, 1, -2, 500.0, 1000.0, 100.0, 200.0, 50.0, 50.0, 0), (1, 1, -1, 1000.0, 1000.0, 0.0, 0.0, 100.0, 20.0, 5),
        (2, 1, -10, 50.0, 0.0, None, 0.0, 0.0, None, 0), (3, 2, -1, 300.0, 1000.0, 0.0, 0.0, 0.0, None, 0)],
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double,"
        "AMT_DRAWINGS_ATM_CURRENT double, AMT_DRAWINGS_CURRENT double, AMT_INST_MIN_REGULARITY double,"
        "AMT_PAYMENT_CURRENT double, SK_DPD int")
    got = by_key(credit_card.card_features(df))
    a, b = got[1], got[2]
    assert (a["CC_CARDS"], a["CC_UTIL_MAX"], a["CC_UTIL_LATEST_MEAN"], a["CC_UTIL_6M_MEAN"]) == (2, 1, 1, 0.75)
    assert a["CC_BELOW_MIN_SHARE_MEAN"] == 0.5 and a["CC_PAY_TO_MIN_MEAN"] == pytest.approx(0.6)
    assert (a["CC_CASH_SHARE_MEAN"], a["CC_DPD_MAX"], a["CC_DPD_MONTHS_TOTAL"]) == (0.5, 5, 1)
    assert b["CC_UTIL_MEAN"] == 0.3 and b["CC_BELOW_MIN_SHARE_MEAN"] is None


def test_attach(spark):
    base = spark.createDataFrame([(1, .1), (2, .2), (3, .3)], "SK_ID_CURR long, APP_X double")
    part = spark.createDataFrame([(1, 2, 1.5), (3, 5, 2.5)], "SK_ID_CURR long, T_COUNT long, T_MEAN double")
    got = by_key(attach(base, part, ["T_COUNT"], "T_HAS_HISTORY"))
    assert [got[i]["T_COUNT"] for i in (1, 2, 3)] == [2, 0, 5]
    assert [got[i]["T_MEAN"] for i in (1, 2, 3)] == [1.5, None, 2.5]
    assert [got[i]["T_HAS_HISTORY"] for i in (1, 2, 3)] == [1, 0, 1]
    with pytest.raises(ValueError):
        assert_unique(part.union(part), "SK_ID_CURR")


def test_nan_is_missing(loans, months):
    spoiled = loans.withColumn("AMT_CREDIT_SUM", F.when(F.col("SK_ID_BUREAU") == 10, float("nan")).otherwise(F.col("AMT_CREDIT_SUM")))
    got = by_key(bureau.bureau_features(spoiled, months))[1]
    assert got["BUR_CREDIT_TOTAL"] == 2000.0 and got["BUR_ACTIVE_CREDIT_TOTAL"] is None


def test_whole_plan_has_one_row_per_applicant(spark, sf_dir):
    from lendframe.plans.adapters import reader, view
    from lendframe.plans.feature_table import FAMILIES, feature_table
    df = feature_table(reader(spark, sf_dir))
    n = view(spark, sf_dir, "application").count()
    row = df.agg(F.count("*").alias("n"), F.count_distinct("SK_ID_CURR").alias("k")).first()
    assert (row["n"], row["k"]) == (n, n)
    assert all(c in application.KEYS or c.startswith(tuple(FAMILIES)) for c in df.columns)
    assert len(set(df.columns)) == len(df.columns)
    assert [sum(c.startswith(p) for c in df.columns) for p in FAMILIES[1:]] == [31, 9, 32, 22, 12, 14]
    doubles = [c for c, t in df.dtypes if t == "double"]
    bad = df.agg(*[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in doubles]).first()
    assert not any(bad)
