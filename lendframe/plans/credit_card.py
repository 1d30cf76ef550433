"""Monthly card snapshots: month -> card -> applicant, prefix CC_."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import clip0, flag, null_clean, only_if, sdiv, sum0
from lendframe.operators.latest import latest_of

# Input columns
CARD_COLUMNS = ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "AMT_BALANCE",
                "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT",
                "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT", "SK_DPD"]
COUNTS = ["CC_CARDS", "CC_DPD_MONTHS_TOTAL", "CC_LIMIT_CHANGES_TOTAL"]


def card_features(cards: DataFrame) -> DataFrame:
    """One row per applicant. Months without a limit, a minimum or a drawing are not counted."""
    c = F.col
    limit, minimum, paid = (c("AMT_CREDIT_LIMIT_ACTUAL"), c("AMT_INST_MIN_REGULARITY"),
                            c("AMT_PAYMENT_CURRENT"))
    drawn, atm = clip0(c("AMT_DRAWINGS_CURRENT")), clip0(c("AMT_DRAWINGS_ATM_CURRENT"))
    keys = ["SK_ID_CURR", "SK_ID_PREV"]
    months = null_clean(cards.select(*CARD_COLUMNS)).dropna(subset=keys).withColumns({
        "util": only_if(limit > 0, sdiv(c("AMT_BALANCE"), limit)),
        "pay_to_min": only_if(minimum > 0, sdiv(paid, minimum)),
        "below_min": only_if(minimum > 0, flag(F.coalesce(paid, F.lit(0)) < minimum)),
        "cash_share": only_if(drawn > 0, sdiv(atm, drawn)),
        "drawn": drawn})
    month = c("MONTHS_BALANCE")
    per_card = months.groupBy(*keys).agg(
        F.count("*").alias("months"), F.avg("util").alias("util"), F.max("util").alias("util_max"),
        F.avg(only_if(month >= -6, c("util"))).alias("util_6m"),
        F.avg("below_min").alias("below_min"), F.avg("pay_to_min").alias("pay_to_min"),
        F.avg("cash_share").alias("cash_share"), F.max("SK_DPD").alias("dpd_max"),
        F.sum(flag(c("SK_DPD") > 0)).alias("dpd_months"),
        F.greatest(F.count_distinct(limit) - 1, F.lit(0)).alias("limit_changes"),
        sum0(c("drawn")).alias("drawn"),
        latest_of([c("util")], [month, c("AMT_BALANCE"), limit]).alias("last"))
    return per_card.groupBy("SK_ID_CURR").agg(
        F.count("*").alias("CC_CARDS"), F.avg("months").alias("CC_MONTHS_MEAN"),
        F.avg("util").alias("CC_UTIL_MEAN"), F.max("util_max").alias("CC_UTIL_MAX"),
        F.avg("last.util").alias("CC_UTIL_LATEST_MEAN"), F.avg("util_6m").alias("CC_UTIL_6M_MEAN"),
        F.avg("below_min").alias("CC_BELOW_MIN_SHARE_MEAN"),
        F.avg("pay_to_min").alias("CC_PAY_TO_MIN_MEAN"),
        F.avg("cash_share").alias("CC_CASH_SHARE_MEAN"), F.max("dpd_max").alias("CC_DPD_MAX"),
        F.sum("dpd_months").alias("CC_DPD_MONTHS_TOTAL"),
        F.sum("limit_changes").alias("CC_LIMIT_CHANGES_TOTAL"),
        F.sum("drawn").alias("CC_DRAWN_TOTAL"))
