"""Loan-shaped views of the test tables (TPC-H-like customers, orders, lines and events).

Each view is a list of (expression, name) in SQL that both Spark and the checking engine read the
same way; only the two date helpers DAYS(x) and EVDAYS(x) are spelled differently per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lendframe.session import tasks_for, width

# days before 2001-11-05 (orders, lines) and before 2024-02-01 (events), both negative
SPARK_DATES = {"DAYS": r"datediff(\1, DATE'2001-11-05')",
               "EVDAYS": r"datediff(\1, DATE'2024-02-01')"}
DUCK_DATES = {"DAYS": r"CAST(date_diff('day', DATE '2001-11-05', CAST(\1 AS DATE)) AS INTEGER)",
              "EVDAYS": r"CAST(date_diff('day', DATE '2024-02-01', CAST(\1 AS DATE)) AS INTEGER)"}


def _dates(text: str, rules: dict[str, str]) -> str:
    for name, sql in rules.items():
        text = re.sub(rf"\b{name}\((\w+)\)", sql, text)
    return text


DOCUMENT_COLUMNS = [(f"CAST(CASE WHEN c_custkey % {i + 3} = 0 THEN 1 ELSE 0 END AS INT)",
                     f"FLAG_DOCUMENT_{i}") for i in range(2, 22)]
REQUEST_COLUMNS = [(f"CASE WHEN c_acctbal > 0 THEN CAST(c_custkey % {i + 2} AS DOUBLE) END",
                    f"AMT_REQ_CREDIT_BUREAU_{s}")
                   for i, s in enumerate(("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR"))]
APPLICATION = [
    ("c_custkey", "SK_ID_CURR"),
    ("CASE WHEN c_custkey % 8 <> 7 THEN CAST(CASE WHEN (c_custkey * 7919) % 1000 < 320 - c_acctbal / 4e1"
     " THEN 1 ELSE 0 END AS INT) END", "TARGET"),
    ("CAST(CASE WHEN c_custkey % 8 = 7 THEN 1 ELSE 0 END AS INT)", "is_test"),
    ("CASE WHEN c_custkey % 97 = 5 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END",
     "CODE_GENDER"),
    ("CASE WHEN c_custkey % 10 = 3 THEN 'Revolving loans' ELSE 'Cash loans' END", "NAME_CONTRACT_TYPE"),
    ("CASE WHEN c_nationkey < 9 THEN 'Secondary' WHEN c_nationkey < 20 THEN 'Higher' ELSE 'Lower' END",
     "NAME_EDUCATION_TYPE"),
    ("CASE WHEN c_custkey % 5 = 0 THEN 'Pensioner' ELSE 'Working' END", "NAME_INCOME_TYPE"),
    ("CASE WHEN c_custkey % 4 = 0 THEN 'Single' ELSE 'Married' END", "NAME_FAMILY_STATUS"),
    ("CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END", "OCCUPATION_TYPE"),
    ("concat('Org ', CAST(c_nationkey AS VARCHAR(10)))", "ORGANIZATION_TYPE"),
    ("CAST(c_custkey % 3 AS INT)", "CNT_CHILDREN"),
    ("CASE WHEN c_custkey % 50 <> 1 THEN CAST(c_custkey % 3 + c_custkey % 2 AS DOUBLE) END",
     "CNT_FAM_MEMBERS"),
    ("c_acctbal + 1e3", "AMT_INCOME_TOTAL"),
    ("(c_custkey % 40 + 5) * 1e2", "AMT_CREDIT"),
    ("CASE WHEN c_custkey % 90 <> 2 THEN (c_custkey % 40 + 5) * 1e2 / (8 + c_custkey % 9) END",
     "AMT_ANNUITY"),
    ("CASE WHEN c_custkey % 60 <> 4 THEN (c_custkey % 40 + 5) * 9e1 END", "AMT_GOODS_PRICE"),
    ("CASE WHEN c_acctbal >= 0 THEN (c_custkey % 101) / 1e2 END", "EXT_SOURCE_1"),
    ("(c_acctbal + 1e3) / 1.1e4", "EXT_SOURCE_2"),
    ("CASE WHEN c_custkey % 5 <> 2 THEN (c_custkey % 89) / 8.9e1 END", "EXT_SOURCE_3"),
    ("CAST(-7500 - (c_custkey * 13) % 17000 AS INT)", "DAYS_BIRTH"),
    ("CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 29) % 7000) END AS INT)",
     "DAYS_EMPLOYED"),
    ("CAST(-((c_custkey * 17) % 9000) AS DOUBLE)", "DAYS_REGISTRATION"),
    ("CAST(-((c_custkey * 11) % 5000) AS INT)", "DAYS_ID_PUBLISH"),
    ("CAST(-((c_custkey * 7) % 3000) AS DOUBLE)", "DAYS_LAST_PHONE_CHANGE"),
    ("CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 25 AS DOUBLE) END", "OWN_CAR_AGE"),
    ("CAST(c_nationkey % 3 + 1 AS INT)", "REGION_RATING_CLIENT"),
    ("CAST(1 AS INT)", "FLAG_MOBIL"), ("CAST(1 AS INT)", "FLAG_CONT_MOBILE"),
    *DOCUMENT_COLUMNS, *REQUEST_COLUMNS,
]
BUREAU = [
    ("o_custkey", "SK_ID_CURR"), ("o_orderkey", "SK_ID_BUREAU"),
    ("CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed'"
     " WHEN o_orderkey % 5 = 0 THEN 'Bad debt' ELSE 'Sold' END", "CREDIT_ACTIVE"),
    ("CASE WHEN o_orderpriority = '1-URGENT' THEN 'Microloan' WHEN o_orderpriority = '2-HIGH'"
     " THEN 'Credit card' WHEN o_orderpriority = '3-MEDIUM' THEN 'Consumer credit'"
     " WHEN o_orderpriority = '5-LOW' THEN 'Mortgage' ELSE 'Car loan' END", "CREDIT_TYPE"),
    ("DAYS(o_orderdate)", "DAYS_CREDIT"),
    ("CAST(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 60 ELSE 0 END AS INT)",
     "CREDIT_DAY_OVERDUE"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN -9e3 WHEN o_orderkey % 17 = 0 THEN 4e4 WHEN o_orderkey % 7 <> 0"
     " THEN CAST(DAYS(o_orderdate) + o_orderkey % 2000 AS DOUBLE) END", "DAYS_CREDIT_ENDDATE"),
    ("CASE WHEN o_orderstatus = 'F' THEN CAST(DAYS(o_orderdate) + o_orderkey % 900 - 20 AS DOUBLE) END",
     "DAYS_ENDDATE_FACT"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 500 AS DOUBLE) END", "AMT_CREDIT_MAX_OVERDUE"),
    ("CAST(o_orderkey % 3 AS INT)", "CNT_CREDIT_PROLONG"),
    ("CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END", "AMT_CREDIT_SUM"),
    ("CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 3000 - 200 AS DOUBLE) END",
     "AMT_CREDIT_SUM_DEBT"),
    ("CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 800 - 50 AS DOUBLE) END",
     "AMT_CREDIT_SUM_LIMIT"),
    ("CAST(o_orderkey % 21 - 5 AS DOUBLE)", "AMT_CREDIT_SUM_OVERDUE"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 400 AS DOUBLE) END", "AMT_ANNUITY"),
]
BALANCE = [
    ("l_orderkey", "SK_ID_BUREAU"),
    ("CAST(floor(DAYS(l_shipdate) / 3.04375e1) AS INT)", "MONTHS_BALANCE"),
    ("CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'X' WHEN l_returnflag = 'N' THEN 'C'"
     " WHEN l_returnflag = 'A' THEN '0' ELSE CAST(CAST(1 + l_linenumber % 5 AS INT) AS VARCHAR(2)) END",
     "STATUS"),
]
PREVIOUS = [
    ("o_orderkey", "SK_ID_PREV"), ("o_custkey", "SK_ID_CURR"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN 'Cash loans' WHEN o_orderkey % 3 = 1 THEN 'Consumer loans'"
     " ELSE 'Revolving loans' END", "NAME_CONTRACT_TYPE"),
    ("CASE WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'P' THEN 'Refused'"
     " WHEN o_orderkey % 4 = 0 THEN 'Unused offer' WHEN o_orderkey % 4 = 1 THEN 'Approved'"
     " ELSE 'Canceled' END", "NAME_CONTRACT_STATUS"),
    ("o_totalprice", "AMT_APPLICATION"),
    ("CASE WHEN o_orderkey % 29 = 0 THEN 0e0 ELSE o_totalprice * (8 + o_orderkey % 5) / 1e1 END",
     "AMT_CREDIT"),
    ("CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 1.2e1 END", "AMT_ANNUITY"),
    ("CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice * 9e-1 END", "AMT_GOODS_PRICE"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10) / 1e1 END", "RATE_DOWN_PAYMENT"),
    ("CASE WHEN o_orderkey % 14 <> 0 THEN CAST(o_orderkey % 24 AS DOUBLE) END", "CNT_PAYMENT"),
    ("CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'middle' END", "NAME_YIELD_GROUP"),
    ("DAYS(o_orderdate)", "DAYS_DECISION"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN 'x-sell' ELSE 'walk-in' END", "NAME_PRODUCT_TYPE"),
    ("CASE WHEN o_orderkey % 31 = 0 THEN 'N' ELSE 'Y' END", "FLAG_LAST_APPL_PER_CONTRACT"),
    ("CAST(CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE 1 END AS INT)", "NFLAG_LAST_APPL_IN_DAY"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN 365243e0 END", "DAYS_FIRST_DRAWING"),
    ("CAST(DAYS(o_orderdate) + 30 AS DOUBLE)", "DAYS_FIRST_DUE"),
    ("CAST(DAYS(o_orderdate) + 300 AS DOUBLE)", "DAYS_LAST_DUE_1ST_VERSION"),
    ("CASE WHEN o_orderkey % 6 = 0 THEN 365243e0 ELSE CAST(DAYS(o_orderdate) + o_orderkey % 700 AS DOUBLE) END",
     "DAYS_LAST_DUE"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN 365243e0 WHEN o_orderkey % 5 = 1 THEN CAST(DAYS(o_orderdate)"
     " + o_orderkey % 900 AS DOUBLE) END", "DAYS_TERMINATION"),
]
INSTALLMENTS = [
    ("l_orderkey", "SK_ID_PREV"), ("o_custkey", "SK_ID_CURR"),
    ("CAST(l_suppkey % 3 AS DOUBLE)", "NUM_INSTALMENT_VERSION"),
    ("l_linenumber", "NUM_INSTALMENT_NUMBER"),
    ("CAST(DAYS(o_orderdate) + 30 * l_linenumber AS DOUBLE)", "DAYS_INSTALMENT"),
    ("CASE WHEN l_quantity <> 50 THEN CAST(DAYS(l_shipdate) AS DOUBLE) END", "DAYS_ENTRY_PAYMENT"),
    ("CASE WHEN l_partkey % 40 = 0 THEN 0e0 ELSE l_extendedprice END", "AMT_INSTALMENT"),
    ("CASE WHEN l_quantity <> 50 THEN l_extendedprice * (1 - l_discount) END", "AMT_PAYMENT"),
]
POS = [
    ("user_id * 10 + event_id % 7", "SK_ID_PREV"), ("user_id", "SK_ID_CURR"),
    ("EVDAYS(ts)", "MONTHS_BALANCE"),
    ("CASE WHEN event_id % 12 <> 0 THEN CAST(6 + event_id % 3 AS DOUBLE) END", "CNT_INSTALMENT"),
    ("CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 24 AS DOUBLE) END", "CNT_INSTALMENT_FUTURE"),
    ("CASE WHEN event_type = 'purchase' THEN 'Completed' WHEN event_type = 'signup' THEN 'Demand'"
     " ELSE 'Active' END", "NAME_CONTRACT_STATUS"),
    ("CAST(CASE WHEN event_type = 'error' THEN floor(value) ELSE 0 END AS INT)", "SK_DPD"),
    ("CAST(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN floor(value) ELSE 0 END AS INT)",
     "SK_DPD_DEF"),
]
CARDS = [
    ("user_id * 10 + event_id % 3", "SK_ID_PREV"), ("user_id", "SK_ID_CURR"),
    ("EVDAYS(ts)", "MONTHS_BALANCE"),
    ("value", "AMT_BALANCE"),
    ("CAST((event_id % 4) * 50 AS DOUBLE)", "AMT_CREDIT_LIMIT_ACTUAL"),
    ("CASE WHEN event_id % 5 <> 0 THEN value / 4e0 - 1e0 END", "AMT_DRAWINGS_ATM_CURRENT"),
    ("value / 2e0 - 2e0", "AMT_DRAWINGS_CURRENT"),
    ("CASE WHEN event_id % 3 <> 0 THEN CAST((event_id % 6) * 10 AS DOUBLE) END",
     "AMT_INST_MIN_REGULARITY"),
    ("CASE WHEN event_id % 7 <> 0 THEN value / 3e0 END", "AMT_PAYMENT_CURRENT"),
    ("CAST(CASE WHEN event_type = 'error' THEN floor(value) ELSE 0 END AS INT)", "SK_DPD"),
]
# one scored application per order: label, two scores, amount, groups and part of the data
SCORES = [
    ("o_orderkey", "id"),
    ("CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT)", "y"),
    ("((o_orderkey * 7919) % 1000 / 1e3 + CASE WHEN o_orderstatus = 'F' THEN 3e-1 ELSE 0e0 END"
     " + o_totalprice / 2e6) / 1.6e0", "p"),
    ("((o_orderkey * 104729) % 500 / 5e2 + CASE WHEN o_orderstatus = 'F' THEN 2e-1 ELSE 0e0 END) / 1.3e0",
     "p2"),
    ("o_totalprice", "amount"),
    ("o_orderpriority", "grp"),
    ("CASE WHEN o_custkey % 3 = 0 THEN 'M' ELSE 'F' END", "sex"),
    ("CAST(20 + o_custkey % 55 AS DOUBLE)", "age"),
    ("o_custkey", "cust"),
    ("CASE WHEN o_orderkey % 10 < 4 THEN 'conformal' ELSE 'valid' END", "part"),
]
# one scored row per order line: many rows, many tied scores
LINE_SCORES = [
    ("CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT)", "y"),
    ("(3 * l_discount + 2 * l_tax + l_quantity / 1e2 + 1e-1"
     " + CASE WHEN l_returnflag = 'R' THEN 1.5e-1 ELSE 0e0 END) / 1.3e0", "p"),
    ("l_linestatus", "grp"), ("l_extendedprice", "amount"),
]
VIEWS = {
    "application": (APPLICATION, "customer"),
    "bureau": (BUREAU, "orders"),
    "bureau_balance": (BALANCE, "lineitem"),
    "previous_application": (PREVIOUS, "orders"),
    "installments_payments": (INSTALLMENTS, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "pos_cash_balance": (POS, "events"),
    "credit_card_balance": (CARDS, "events"),
    "scores": (SCORES, "orders"),
    "line_scores": (LINE_SCORES, "lineitem"),
}

#: Order lines that one task joins with their orders and sums up.
LINES_A_TASK = 250_000


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A loan-shaped view as a plain projection, so column pruning reaches the scan.

    spread: rows are dealt out to as many tasks as a shuffle has, for costly work on a small file.
    """
    columns, source = VIEWS[name]
    base = (_lines_with_orders(spark, sf_dir) if " JOIN " in source
            else raw(spark, sf_dir, source))
    if spread:
        base = base.repartition(width(spark))
    return base.selectExpr(*[f"{_dates(e, SPARK_DATES)} AS {n}" for e, n in columns])


def _lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by the order, in tasks of a bounded number of rows: joined and summed up there without another shuffle."""
    lines, orders = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders")
    n = max(tasks_for(lines, LINES_A_TASK), spark.sparkContext.defaultParallelism)
    lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def loans_with_months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The views bureau and bureau_balance, dealt out by the loan where a task of a plain shuffle would hold too many months."""
    views = view(spark, sf_dir, "bureau"), view(spark, sf_dir, "bureau_balance")
    n = tasks_for(raw(spark, sf_dir, "lineitem"), LINES_A_TASK)
    return tuple(v.repartition(n, "SK_ID_BUREAU") for v in views) if n > width(spark) else views


def reader(spark: SparkSession, sf_dir: str):
    """read(name, columns) for feature_table."""
    def read(name: str, columns=None) -> DataFrame:
        if name.startswith("application_"):
            test = int(name == "application_test")
            df = view(spark, sf_dir, "application").where(f"is_test = {test}").drop("is_test")
            df = df.drop("TARGET") if test else df
        elif name in ("bureau", "bureau_balance"):
            df = loans_with_months(spark, sf_dir)[name == "bureau_balance"]
        else:
            df = view(spark, sf_dir, name)
        return df.select(*columns) if columns else df
    return read


def duck_view(name: str) -> str:
    """The same view as a CTE for the checking engine."""
    columns, source = VIEWS[name]
    body = ", ".join(f"{_dates(e, DUCK_DATES)} AS {n}" for e, n in columns)
    return f"{name} AS (SELECT {body} FROM {source})"
