"""Loans at other lenders and their monthly status: month -> loan -> applicant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import clip0, flag, null_clean, only_if, sdiv

# Input columns and loan type names
BUREAU_COLUMNS = [
    "SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE", "DAYS_CREDIT",
    "CREDIT_DAY_OVERDUE", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "AMT_CREDIT_MAX_OVERDUE",
    "CNT_CREDIT_PROLONG", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT",
    "AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY"]
BALANCE_COLUMNS = ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"]
LOAN_TYPES = {"Consumer credit": "CONSUMER", "Credit card": "CARD", "Car loan": "CAR",
              "Mortgage": "MORTGAGE", "Microloan": "MICROLOAN"}
COUNTS = ["BUR_COUNT", "BUR_ACTIVE_COUNT", "BUR_CLOSED_COUNT", "BUR_SOLD_OR_BAD_COUNT",
          "BUR_LOANS_LAST_YEAR", "BUR_PROLONG_TOTAL", "BB_LOANS_WITH_HISTORY",
          *[f"BUR_{t}_COUNT" for t in LOAN_TYPES.values()]]
YEAR = 365.25
LONGEST_DAYS = 50 * YEAR


def monthly_status(balance: DataFrame) -> DataFrame:
    """One row per external loan. Levels 0..5 are days-late classes; C and X carry no level."""
    # try_cast works by catching an exception per bad value, so the two known letters skip it
    level = F.when(~F.col("STATUS").isin("C", "X"), F.col("STATUS").try_cast("int"))
    late = flag(level >= 1)
    closed, unknown = flag(F.col("STATUS") == "C"), flag(F.col("STATUS") == "X")
    month = F.col("MONTHS_BALANCE")
    per_loan = (balance.select(*BALANCE_COLUMNS).where("SK_ID_BUREAU IS NOT NULL")
                .groupBy("SK_ID_BUREAU").agg(
        F.count("*").alias("BB_MONTHS"),
        (-F.min(month)).alias("BB_HISTORY_MONTHS"),
        F.max(level).alias("BB_WORST_STATUS"),
        F.sum(late).alias("BB_LATE_MONTHS"),
        F.sum(only_if(flag(month >= -12) == 1, late)).alias("_recent"),
        F.avg(unknown).alias("BB_UNKNOWN_SHARE"),
        F.count(level).alias("_known"),
        # month, closed and late in one whole number, so the latest row is a plain max and the
        # largest table aggregates by hashing instead of sorting
        F.max(month.cast("bigint") * 4 + closed * 2 + late).alias("_last")))
    return per_loan.select(
        "SK_ID_BUREAU", "BB_MONTHS", "BB_HISTORY_MONTHS", "BB_WORST_STATUS", "BB_LATE_MONTHS",
        F.coalesce("_recent", F.lit(0)).alias("BB_LATE_12M"), "BB_UNKNOWN_SHARE",
        sdiv(F.col("BB_LATE_MONTHS"), F.col("_known")).alias("BB_LATE_SHARE"),
        F.pmod("_last", F.lit(2)).cast("int").alias("BB_LATEST_LATE"),
        F.floor(F.pmod("_last", F.lit(4)) / 2).cast("int").alias("BB_LATEST_CLOSED"))


def clean_loans(bureau: DataFrame) -> DataFrame:
    """Impossible end dates become NULL, negative money becomes 0."""
    start = F.col("DAYS_CREDIT")
    planned, actual = F.col("DAYS_CREDIT_ENDDATE"), F.col("DAYS_ENDDATE_FACT")
    money = ["AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE"]
    return null_clean(bureau.select(*BUREAU_COLUMNS)).withColumns({
        "DAYS_CREDIT_ENDDATE": only_if((planned >= start) & (planned <= LONGEST_DAYS), planned),
        "DAYS_ENDDATE_FACT": only_if(actual >= start, actual),
        **{c: clip0(F.col(c)) for c in money}})


def bureau_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """One row per applicant: BUR_ from the loans, BB_ from their months."""
    loans = (clean_loans(bureau).where("SK_ID_CURR IS NOT NULL")
             .join(monthly_status(balance), on="SK_ID_BUREAU", how="left"))
    c = F.col
    start = c("DAYS_CREDIT")
    active, closed = c("CREDIT_ACTIVE") == "Active", c("CREDIT_ACTIVE") == "Closed"
    aggregates = {
        "BUR_COUNT": F.count("*"),
        "BUR_ACTIVE_COUNT": F.sum(flag(active)),
        "BUR_CLOSED_COUNT": F.sum(flag(closed)),
        "BUR_SOLD_OR_BAD_COUNT": F.sum(flag(c("CREDIT_ACTIVE").isin("Sold", "Bad debt"))),
        "BUR_LOANS_LAST_YEAR": F.sum(flag(start >= -365)),
        "BUR_OLDEST_LOAN_YEARS": -F.min(start) / YEAR,
        "BUR_NEWEST_LOAN_YEARS": -F.max(start) / YEAR,
        "BUR_MEAN_LOAN_AGE_YEARS": -F.avg(start) / YEAR,
        "BUR_ACTIVE_ENDS_IN_YEARS": F.max(only_if(active, c("DAYS_CREDIT_ENDDATE"))) / YEAR,
        "BUR_CLOSED_DURATION_MEAN_YEARS":
            F.avg(only_if(closed, c("DAYS_ENDDATE_FACT") - start)) / YEAR,
        "BUR_CREDIT_TOTAL": F.sum("AMT_CREDIT_SUM"),
        "BUR_CREDIT_MAX": F.max("AMT_CREDIT_SUM"),
        "BUR_ACTIVE_CREDIT_TOTAL": F.sum(only_if(active, c("AMT_CREDIT_SUM"))),
        "BUR_ACTIVE_DEBT_TOTAL": F.sum(only_if(active, c("AMT_CREDIT_SUM_DEBT"))),
        "BUR_ACTIVE_ANNUITY_TOTAL": F.sum(only_if(active, c("AMT_ANNUITY"))),
        "BUR_OVERDUE_TOTAL": F.sum("AMT_CREDIT_SUM_OVERDUE"),
        "BUR_MAX_OVERDUE_EVER": F.max("AMT_CREDIT_MAX_OVERDUE"),
        "BUR_LIMIT_TOTAL": F.sum("AMT_CREDIT_SUM_LIMIT"),
        "BUR_DAYS_OVERDUE_MAX": F.max("CREDIT_DAY_OVERDUE"),
        "BUR_OVERDUE_NOW_SHARE": F.avg(flag(c("CREDIT_DAY_OVERDUE") > 0)),
        "BUR_PROLONG_TOTAL": F.coalesce(F.sum("CNT_CREDIT_PROLONG"), F.lit(0)),
        **{f"BUR_{short}_COUNT": F.sum(flag(c("CREDIT_TYPE") == name))
           for name, short in LOAN_TYPES.items()},
        "BB_LOANS_WITH_HISTORY": F.count("BB_MONTHS"),
        "BB_HISTORY_MONTHS_MAX": F.max("BB_HISTORY_MONTHS"),
        "BB_WORST_STATUS_MAX": F.max("BB_WORST_STATUS"),
        "BB_LATE_MONTHS_TOTAL": F.sum("BB_LATE_MONTHS"),
        "BB_LATE_12M_TOTAL": F.sum("BB_LATE_12M"),
        "BB_LATE_SHARE_MEAN": F.avg("BB_LATE_SHARE"),
        "BB_LATEST_LATE_SHARE": F.avg("BB_LATEST_LATE"),
        "BB_LATEST_CLOSED_SHARE": F.avg("BB_LATEST_CLOSED"),
        "BB_UNKNOWN_SHARE_MEAN": F.avg("BB_UNKNOWN_SHARE"),
        "_span": F.max(start) - F.min(start),
    }
    out = loans.groupBy("SK_ID_CURR").agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.withColumns({
        "BUR_DEBT_RATIO_ACTIVE": sdiv(c("BUR_ACTIVE_DEBT_TOTAL"), c("BUR_ACTIVE_CREDIT_TOTAL")),
        "BUR_AVG_GAP_DAYS": sdiv(c("_span"), c("BUR_COUNT") - 1),
    }).drop("_span")
