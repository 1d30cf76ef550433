"""Scenarios and counterfactuals on the stored history."""

import pytest
from pyspark.sql import functions as F

from lendframe.operators import drift
from lendframe.plans import what_if
from lendframe.plans.adapters import view
from lendframe.queries.features import features
from lendframe.queries.scenarios import MODEL, history_score
from lendframe.session import durable


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return durable(features(spark, sf_dir))


def test_a_scenario_without_changes_gives_the_stored_features(spark, sf_dir, stored):
    raw = view(spark, sf_dir, "application")
    rows = what_if.scenario_rows(raw, stored, history_score)
    assert rows.count() == stored.count() * len(what_if.SCENARIOS)
    cols = ["SK_ID_CURR", "p", *MODEL, "BUR_ACTIVE_DEBT_TOTAL", "PREV_CREDIT_MEAN"]
    same = rows.where("scenario = 'as they are'").select(cols)
    assert same.exceptAll(history_score(stored).select(cols)).count() == 0 and same.count() == stored.count()
    # income moves the ratios that are built from it, and nothing else
    ratio = rows.groupBy("SK_ID_CURR").pivot("scenario", list(what_if.SCENARIOS)).agg(F.first("BUR_DEBT_TO_INCOME"))
    ratio = ratio.where("`as they are` <> 0").select((F.col("income 20% lower") / F.col("as they are")).alias("r"),
                                                     (F.col("loans 20% larger") / F.col("as they are")).alias("l"))
    got = ratio.agg(F.min("r"), F.max("r"), F.min("l"), F.max("l"), F.count("*")).first()
    assert got[4] > 0 and got[0] == pytest.approx(1.25) and got[1] == pytest.approx(1.25) and got[2] == got[3] == 1


def test_an_empty_field_stays_empty_in_every_scenario(spark):
    shape = "SK_ID_CURR long, " + ", ".join(f"{f} double" for f in what_if.FIELDS)
    rows = what_if.scenario_changes(spark.createDataFrame([(1, 100.0, 50.0, None, 30.0, None, None, 0.5, None)], shape)).collect()
    got = {r.scenario: r for r in rows}
    assert got["as they are"].income is None and got["income 20% lower"].income == pytest.approx(80)
    low = got["external scores 20% lower"]
    assert low.ext_source_1 is None and low.ext_source_2 == pytest.approx(0.4) and low.loan_amount is None
    assert got["loans 20% larger"].loan_amount == pytest.approx(60) and got["loans 20% larger"].annuity is None


def test_drift_by_group_equals_one_table_a_group(spark):
    reference = spark.range(500).select((F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("b"))
    new = spark.range(300).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), (F.col("id") % 20 + 0.5).alias("a"),
                                  F.when(F.col("id") % 7 > 0, F.col("id") * 2.0).alias("b"))
    got = {(r.g, r["column"]): (round(r.psi, 9), r.status) for r in drift.psi_by(reference, new, "g", ["a", "b"]).collect()}
    want = {(g, r["column"]): (round(r.psi, 9), r.status) for g in "xy"
            for r in drift.psi_table(reference, new.where(F.col("g") == g), numeric=["a", "b"]).collect()}
    assert got == want and len(got) == 4
