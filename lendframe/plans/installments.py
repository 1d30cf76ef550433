"""Repayments on own old loans: part payment -> installment -> loan -> applicant, prefix INST_."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import clip0, flag, null_clean, only_if, sdiv, sum0

# Input columns
INSTALLMENT_COLUMNS = [
    "SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER",
    "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]
COUNTS = ["INST_COUNT", "INST_MISSED_COUNT", "INST_LOANS", "INST_12M_COUNT"]


def per_installment(rows: DataFrame) -> DataFrame:
    """One row per (applicant, loan, installment number); its parts are added up."""
    keys = ["SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER"]
    known = rows.dropna(subset=keys)
    merged = known.groupBy(*keys).agg(
        F.max("AMT_INSTALMENT").alias("due"), sum0(F.col("AMT_PAYMENT")).alias("paid"),
        F.max("DAYS_INSTALMENT").alias("due_day"), F.max("DAYS_ENTRY_PAYMENT").alias("last_pay"),
        F.count("*").alias("parts"))
    wait = F.col("last_pay") - F.col("due_day")
    due, paid = F.col("due"), F.col("paid")
    return merged.withColumns({
        "dpd": clip0(wait), "dbd": clip0(-wait), "late": flag(wait > 0),
        "missed": F.isnull("last_pay").cast("int"),
        "paid_ratio": only_if(due > 0, sdiv(paid, due)),
        "underpaid": clip0(due - paid), "recent": flag(F.col("due_day") >= -365)})


def installment_features(rows: DataFrame) -> DataFrame:
    """One row per applicant.

    All-time and last-365-day figures come from the same aggregate. The loan level carries sums
    and counts upwards, so applicant figures over installments need no second pass.
    """
    rows = null_clean(rows.select(*INSTALLMENT_COLUMNS))
    per = per_installment(rows)
    c = F.col
    near = c("recent") == 1
    loan = per.groupBy("SK_ID_CURR", "SK_ID_PREV").agg(
        F.count("*").alias("n"), F.sum("late").alias("late"), F.sum("dpd").alias("dpd"),
        F.count("dpd").alias("dpd_n"), F.max("dpd").alias("dpd_max"), F.sum("dbd").alias("dbd"),
        F.count("dbd").alias("dbd_n"), F.sum("paid_ratio").alias("ratio"),
        F.count("paid_ratio").alias("ratio_n"), F.min("paid_ratio").alias("ratio_min"),
        F.sum("underpaid").alias("under"), F.max("underpaid").alias("under_max"),
        F.sum("missed").alias("missed"), F.sum(flag(c("parts") > 1)).alias("split"),
        F.sum("recent").alias("n12"), F.sum(only_if(near, c("late"))).alias("late12"),
        F.sum(only_if(near, c("dpd"))).alias("dpd12"),
        F.count(only_if(near, c("dpd"))).alias("dpd12_n"),
        F.max(only_if(near, c("dpd"))).alias("dpd12_max"),
        F.sum(only_if(near, c("paid_ratio"))).alias("ratio12"),
        F.count(only_if(near, c("paid_ratio"))).alias("ratio12_n"),
        F.sum(only_if(near, c("underpaid"))).alias("under12"))
    # version changes are a property of the loan over all its rows, whoever they belong to
    versions = (rows.where("SK_ID_PREV IS NOT NULL").groupBy("SK_ID_PREV")
                .agg((F.count_distinct("NUM_INSTALMENT_VERSION") - 1).alias("changes")))
    loan = loan.join(versions, on="SK_ID_PREV", how="left")
    total = F.sum("n")
    some_recent = F.sum("n12") > 0
    aggregates = {
        "INST_COUNT": total,
        "INST_LATE_SHARE": sdiv(F.sum("late"), total),
        "INST_DPD_MEAN": sdiv(F.sum("dpd"), F.sum("dpd_n")),
        "INST_DPD_MAX": F.max("dpd_max"),
        "INST_DBD_MEAN": sdiv(F.sum("dbd"), F.sum("dbd_n")),
        "INST_PAID_RATIO_MEAN": sdiv(F.sum("ratio"), F.sum("ratio_n")),
        "INST_PAID_RATIO_MIN": F.min("ratio_min"),
        "INST_UNDERPAID_TOTAL": sum0(c("under")),
        "INST_UNDERPAID_MAX": F.max("under_max"),
        "INST_MISSED_COUNT": F.sum("missed"),
        "INST_SPLIT_PAYMENTS_SHARE": sdiv(F.sum("split"), total),
        "INST_LOANS": F.count("*"),
        "INST_LOAN_LATE_SHARE_MEAN": F.avg(sdiv(c("late"), c("n"))),
        "INST_LOAN_DPD_MAX_MEAN": F.avg("dpd_max"),
        "INST_VERSION_CHANGES_MAX": F.max("changes"),
        "INST_12M_COUNT": F.sum("n12"),
        "INST_12M_LATE_SHARE": sdiv(F.sum("late12"), F.sum("n12")),
        "INST_12M_DPD_MEAN": sdiv(F.sum("dpd12"), F.sum("dpd12_n")),
        "INST_12M_DPD_MAX": F.max("dpd12_max"),
        "INST_12M_PAID_RATIO_MEAN": sdiv(F.sum("ratio12"), F.sum("ratio12_n")),
        "INST_12M_UNDERPAID_TOTAL": only_if(some_recent, sum0(c("under12"))),
    }
    return loan.groupBy("SK_ID_CURR").agg(*[a.alias(n) for n, a in aggregates.items()])
