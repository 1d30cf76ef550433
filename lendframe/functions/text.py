"""Text for people: feature names, values and reason sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readable names of common features
LABELS = {
    "APP_EXT_MEAN": "External credit scores (average)",
    "APP_EXT_MIN": "External credit scores (lowest)",
    "APP_EXT_MAX": "External credit scores (highest)",
    "APP_EXT_STD": "External credit scores (spread)",
    "APP_EXT_PROD": "External credit scores (product)",
    "APP_EXT_NA_COUNT": "External credit scores missing",
    "APP_EXT_SOURCE_1": "External credit score 1",
    "APP_EXT_SOURCE_2": "External credit score 2",
    "APP_EXT_SOURCE_3": "External credit score 3",
    "APP_ANNUITY_TO_CREDIT": "Annuity ÷ loan amount (repayment speed)",
    "APP_CREDIT_TO_INCOME": "Loan amount ÷ income",
    "APP_ANNUITY_TO_INCOME": "Annuity ÷ income",
    "APP_GOODS_TO_CREDIT": "Goods price ÷ loan amount",
    "APP_CREDIT_MINUS_GOODS": "Loan amount above the goods price",
    "APP_INCOME_PER_PERSON": "Income per family member",
    "APP_EMPLOYED_TO_AGE": "Share of life employed",
    "APP_AGE_YEARS": "Age",
    "APP_EMPLOYED_YEARS": "Years employed",
    "APP_DAYS_EMPLOYED_ANOM": "No employment record",
    "APP_REGISTRATION_YEARS": "Years since registration changed",
    "APP_ID_PUBLISH_YEARS": "Years since ID document changed",
    "APP_PHONE_CHANGE_YEARS": "Years since phone changed",
    "APP_AMT_INCOME_TOTAL": "Income",
    "APP_LOG_INCOME": "Income (log)",
    "APP_AMT_CREDIT": "Loan amount",
    "APP_AMT_ANNUITY": "Loan annuity",
    "APP_AMT_GOODS_PRICE": "Goods price",
    "APP_ORGANIZATION_TYPE": "Employer type",
    "APP_OCCUPATION_TYPE": "Occupation",
    "APP_NAME_EDUCATION_TYPE": "Education",
    "APP_NAME_INCOME_TYPE": "Income type",
    "APP_NAME_FAMILY_STATUS": "Family status",
    "APP_NAME_CONTRACT_TYPE": "Contract type",
    "APP_REGION_RATING_CLIENT": "Region rating",
    "APP_REGION_RATING_CLIENT_W_CITY": "Region rating (with city)",
    "APP_DOC_COUNT": "Documents provided",
    "APP_N_MISSING": "Missing fields in the application",
    "APP_OWN_CAR_AGE": "Car age",
    "BUR_DEBT_TO_INCOME": "Credit bureau debt ÷ income",
    "BUR_ANNUITY_BURDEN": "All repayments ÷ income",
    "PREV_CURRENT_TO_MEAN_CREDIT": "This loan vs past loan sizes",
}
# Name of the source table by column prefix
FAMILIES = {
    "APP_": "Application",
    "BUR_": "Credit bureau",
    "BB_": "Bureau monthly status",
    "PREV_": "Previous applications",
    "INST_": "Repayment history",
    "POS_": "POS / cash loans",
    "CC_": "Credit cards",
}
# Short words spelled out
WORDS = {"amt": "amount", "cnt": "count", "dpd": "days past due", "pct": "percent",
         "avg": "average", "num": "number"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def family_of(name: Column) -> Column:
    """Source table of a feature name, "other" when no prefix fits."""
    out = F.lit("other")
    for prefix, table in FAMILIES.items():
        out = F.when(name.startswith(prefix), F.lit(table)).otherwise(out)
    return out


def feature_label(name: Column) -> Column:
    """A known label, else the table name and the spelled-out column words, else the name."""
    words = F.split(F.lower(F.regexp_replace(name, r"^[A-Z]+_", "")), "_")
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(_map(WORDS), w), w))
    built = F.concat(family_of(name), F.lit(": "), F.array_join(spelled, " "))
    generic = F.when(family_of(name) == "other", name).otherwise(built)
    return F.coalesce(F.try_element_at(_map(LABELS), name), generic)


def format_value(value: Column) -> Column:
    """missing / 12,345 / 7 / 0.123"""
    value = value.cast("double")
    return (F.when(value.isNull() | F.isnan(value), F.lit("missing"))
            .when(F.abs(value) >= 1000, F.format_number(value, 0))
            .when(value == F.floor(value), F.format_string("%d", value.cast("bigint")))
            .otherwise(F.format_string("%.3f", value)))


def reason_sentence(label: Column, value: Column) -> Column:
    return F.format_string("%s is %s, which raised the estimated risk.", label, value)


def interval_text(low: Column, high: Column) -> Column:
    return F.format_string("%.4f to %.4f", low, high)
