"""Own earlier applications: one pass of conditional aggregates per applicant, prefix PREV_."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import flag, null_clean, only_if, sdiv
from lendframe.operators.latest import latest_of

# Input columns
PREVIOUS_COLUMNS = [
    "SK_ID_PREV", "SK_ID_CURR", "NAME_CONTRACT_TYPE", "NAME_CONTRACT_STATUS", "AMT_APPLICATION",
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "RATE_DOWN_PAYMENT", "CNT_PAYMENT",
    "NAME_YIELD_GROUP", "DAYS_DECISION", "NAME_PRODUCT_TYPE", "FLAG_LAST_APPL_PER_CONTRACT",
    "NFLAG_LAST_APPL_IN_DAY", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]
COUNTS = ["PREV_COUNT", "PREV_APPROVED_COUNT", "PREV_REFUSED_COUNT", "PREV_CANCELED_COUNT",
          "PREV_UNUSED_COUNT", "PREV_APPS_LAST_YEAR", "PREV_RUNNING_COUNT"]
NO_DATE = 365243
YEAR = 365.25


def prepared_applications(previous: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Duplicate filter, then "running" from the raw end dates.

    365243 in an end date means "not ended"; any later date is in the future. Both are above 0,
    so a loan is running when either raw end date is above 0.
    """
    rows = null_clean(previous.select(*PREVIOUS_COLUMNS)).where("SK_ID_CURR IS NOT NULL")
    if drop_duplicates:
        rows = rows.where("FLAG_LAST_APPL_PER_CONTRACT = 'Y' AND NFLAG_LAST_APPL_IN_DAY = 1")
    open_end = flag(F.col("DAYS_TERMINATION") > 0) + flag(F.col("DAYS_LAST_DUE") > 0) > 0
    return rows.withColumns({
        "approved": flag(F.col("NAME_CONTRACT_STATUS") == "Approved"),
        "refused": flag(F.col("NAME_CONTRACT_STATUS") == "Refused"),
        "running": flag((F.col("NAME_CONTRACT_STATUS") == "Approved") & open_end),
        **{c: F.nullif(F.col(c), F.lit(NO_DATE)) for c in (
            "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
            "DAYS_LAST_DUE", "DAYS_TERMINATION")}})


def previous_features(previous: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """One row per applicant."""
    rows = prepared_applications(previous, drop_duplicates)
    c = F.col
    yes = {s: c(s) == 1 for s in ("approved", "refused", "running")}
    day, credit = c("DAYS_DECISION"), c("AMT_CREDIT")
    ask = sdiv(c("AMT_APPLICATION"), credit)

    def share(column: str, value: str):
        return F.avg(flag(c(column) == value))

    def status(value: str):
        return F.sum(flag(c("NAME_CONTRACT_STATUS") == value))

    aggregates = {
        "PREV_COUNT": F.count("*"),
        "PREV_APPROVED_COUNT": F.sum("approved"),
        "PREV_REFUSED_COUNT": F.sum("refused"),
        "PREV_CANCELED_COUNT": status("Canceled"),
        "PREV_UNUSED_COUNT": status("Unused offer"),
        "PREV_APPS_LAST_YEAR": F.sum(flag(day >= -365)),
        "PREV_APPROVED_SHARE": F.avg("approved"),
        "PREV_REFUSED_SHARE": F.avg("refused"),
        "PREV_YEARS_SINCE_LAST": -F.max(day) / YEAR,
        "PREV_YEARS_SINCE_FIRST": -F.min(day) / YEAR,
        "PREV_YEARS_SINCE_LAST_REFUSAL": -F.max(only_if(yes["refused"], day)) / YEAR,
        "PREV_ASK_TO_GIVEN_MEAN": F.avg(only_if(yes["approved"], ask)),
        "PREV_ASK_TO_GIVEN_MAX": F.max(only_if(yes["approved"], ask)),
        "PREV_GOODS_TO_CREDIT_MEAN":
            F.avg(only_if(yes["approved"], sdiv(c("AMT_GOODS_PRICE"), credit))),
        "PREV_TOTAL_COST_MEAN":
            F.avg(only_if(yes["approved"], sdiv(c("AMT_ANNUITY") * c("CNT_PAYMENT"), credit) - 1)),
        "PREV_CREDIT_MEAN": F.avg(only_if(yes["approved"], credit)),
        "PREV_CREDIT_MAX": F.max(only_if(yes["approved"], credit)),
        "PREV_ANNUITY_MEAN": F.avg(only_if(yes["approved"], c("AMT_ANNUITY"))),
        "PREV_TERM_MEAN": F.avg(only_if(yes["approved"], c("CNT_PAYMENT"))),
        "PREV_REFUSED_ASKED_MEAN": F.avg(only_if(yes["refused"], c("AMT_APPLICATION"))),
        "PREV_DOWN_PAYMENT_RATE_MEAN": F.avg("RATE_DOWN_PAYMENT"),
        "PREV_HIGH_YIELD_SHARE": share("NAME_YIELD_GROUP", "high"),
        "PREV_XSELL_SHARE": share("NAME_PRODUCT_TYPE", "x-sell"),
        "PREV_CASH_SHARE": share("NAME_CONTRACT_TYPE", "Cash loans"),
        "PREV_CONSUMER_SHARE": share("NAME_CONTRACT_TYPE", "Consumer loans"),
        "PREV_REVOLVING_SHARE": share("NAME_CONTRACT_TYPE", "Revolving loans"),
        "PREV_RUNNING_COUNT": F.sum("running"),
        "PREV_RUNNING_CREDIT_TOTAL": F.sum(only_if(yes["running"], credit)),
        "_last": latest_of([c("refused"), flag(c("NAME_CONTRACT_TYPE") == "Cash loans").alias("cash")],
                           [day, c("SK_ID_PREV")]),
    }
    out = rows.groupBy("SK_ID_CURR").agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.withColumns({"PREV_LAST_REFUSED": c("_last.refused"),
                            "PREV_LAST_CASH": c("_last.cash")}).drop("_last")
