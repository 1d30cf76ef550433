"""The whole plan: six summaries, five left joins, one row per applicant."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.nulls import sdiv
from lendframe.operators.joins import attach
from lendframe.plans import application, bureau, credit_card, installments, pos_cash, previous

FAMILIES = ["APP_", "BUR_", "BB_", "PREV_", "INST_", "POS_", "CC_"]
Reader = Callable[[str, Sequence[str] | None], DataFrame]


def cross_ratios() -> dict:
    """Ratios between the application and a history table."""
    c = F.col
    return {
        "BUR_DEBT_TO_INCOME": sdiv(c("BUR_ACTIVE_DEBT_TOTAL"), c("APP_AMT_INCOME_TOTAL")),
        "BUR_ANNUITY_BURDEN": sdiv(
            F.coalesce(c("BUR_ACTIVE_ANNUITY_TOTAL"), F.lit(0.0)) + c("APP_AMT_ANNUITY"),
            c("APP_AMT_INCOME_TOTAL")),
        "PREV_CURRENT_TO_MEAN_CREDIT": sdiv(c("APP_AMT_CREDIT"), c("PREV_CREDIT_MEAN")),
    }


def feature_table(read: Reader, deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``read(name, columns)`` gives one source table. The result is one lazy plan.

    deal: deals rows out by the applicant, the same way for the applications and the finished summaries.
    """
    out = deal(application.application_features(application.stack_labelled(
        read("application_train", None), read("application_test", None))))
    parts = [
        (bureau.bureau_features(read("bureau", bureau.BUREAU_COLUMNS),
                                read("bureau_balance", bureau.BALANCE_COLUMNS)),
         bureau.COUNTS, "BUR_HAS_HISTORY"),
        (previous.previous_features(read("previous_application", previous.PREVIOUS_COLUMNS)),
         previous.COUNTS, "PREV_HAS_HISTORY"),
        (installments.installment_features(
            read("installments_payments", installments.INSTALLMENT_COLUMNS)),
         installments.COUNTS, "INST_HAS_HISTORY"),
        (pos_cash.pos_features(read("pos_cash_balance", pos_cash.POS_COLUMNS)),
         pos_cash.COUNTS, "POS_HAS_HISTORY"),
        (credit_card.card_features(read("credit_card_balance", credit_card.CARD_COLUMNS)),
         credit_card.COUNTS, "CC_HAS_HISTORY"),
    ]
    for part, counts, flag_name in parts:
        out = attach(out, deal(part), counts, flag_name)
    return out.withColumns(cross_ratios())


def family_columns(columns: Sequence[str], families: Sequence[str]) -> list[str]:
    """Columns of the named source tables, in order."""
    return [c for c in columns if c.startswith(tuple(families))]
