"""Monthly status of shop and cash loans: month -> loan -> applicant, prefix POS_."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import flag, null_clean, only_if
from lendframe.operators.latest import latest_of

# Input columns
POS_COLUMNS = ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "CNT_INSTALMENT",
               "CNT_INSTALMENT_FUTURE", "NAME_CONTRACT_STATUS", "SK_DPD", "SK_DPD_DEF"]
COUNTS = ["POS_LOANS", "POS_DEMAND_COUNT", "POS_TERM_CHANGES_TOTAL", "POS_ACTIVE_LOANS"]


def pos_features(pos: DataFrame) -> DataFrame:
    """One row per applicant."""
    c = F.col
    status, month, dpd = c("NAME_CONTRACT_STATUS"), c("MONTHS_BALANCE"), c("SK_DPD")
    keys = ["SK_ID_CURR", "SK_ID_PREV"]
    loans = (null_clean(pos.select(*POS_COLUMNS)).dropna(subset=keys).groupBy(*keys).agg(
        F.count("*").alias("months"), F.max(dpd).alias("dpd_max"),
        F.max("SK_DPD_DEF").alias("dpd_def_max"), F.avg(flag(dpd > 0)).alias("dpd_share"),
        F.max(only_if(month >= -12, dpd)).alias("dpd_12m"),
        F.max(flag(status == "Completed")).alias("completed"),
        F.max(flag(status == "Demand")).alias("demand"),
        F.greatest(F.count_distinct("CNT_INSTALMENT") - 1, F.lit(0)).alias("term_changes"),
        latest_of([c("CNT_INSTALMENT_FUTURE").alias("future"),
                   flag(status == "Active").alias("active")],
                  [month, c("CNT_INSTALMENT_FUTURE"), status]).alias("last")))
    return loans.groupBy("SK_ID_CURR").agg(
        F.count("*").alias("POS_LOANS"), F.avg("months").alias("POS_MONTHS_MEAN"),
        F.max("dpd_max").alias("POS_DPD_MAX"), F.max("dpd_def_max").alias("POS_DPD_DEF_MAX"),
        F.avg("dpd_share").alias("POS_DPD_SHARE_MEAN"), F.max("dpd_12m").alias("POS_12M_DPD_MAX"),
        F.avg("completed").alias("POS_COMPLETED_SHARE"), F.sum("demand").alias("POS_DEMAND_COUNT"),
        F.sum("term_changes").alias("POS_TERM_CHANGES_TOTAL"),
        F.sum("last.active").alias("POS_ACTIVE_LOANS"),
        F.sum("last.future").alias("POS_FUTURE_INSTALLMENTS_TOTAL"))
