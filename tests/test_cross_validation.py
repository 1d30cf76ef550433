"""Joint fits of nested column sets, stored out-of-fold scores, result and ablation tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.models import joint_cv, learners, runner
from lendframe.session import fresh_folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(1500):
        a, b = rng.normal(), rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(1 - a - 0.8 * b)))
        out.append((i, None if i % 9 == 0 else float(a), float(b), ["red", "blue", None][i % 3], f"town {i % 40}", y, i % 5 + 1))
    out.append((9999, 1.0, 1.0, "red", "town 1", None, 1))  # without a label
    return spark.createDataFrame(out, "id long, a double, b double, colour string, town string, y int, fold int")


SETS = {"one": ["a"], "two / b": ["a", "b"], "all": ["a", "b", "colour", "town"]}


def test_joint_fits_are_the_optimum_of_each_model(rows):
    table = joint_cv.prepared(rows, "id", "y", "fold", SETS["all"])
    assert table.large == ["town"] and len(table.one_hot) == 3 and table.flagged == [0]
    fits = joint_cv.fit_logistic(table, SETS, C=0.1)
    local = [(r["k"] - 1, r["y"], r["x"], r["h"], r["t"]) for r in table.rows.collect()]
    fold, y = np.array([r[0] for r in local]), np.array([r[1] for r in local], float)
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in local])
    h, t = np.array([r[3] for r in local]), np.array([r[4] for r in local])
    for name, fit in fits.items():
        assert fit.slope < 1e-4 and len(fit.use) == {"one": 2, "two / b": 3, "all": 7}[name]
        for k in range(5):
            mine = fold != k
            z = joint_cv._inputs(table, k, fold[mine], x[mine], h[mine], t[mine])[:, fit.use]
            p = 1 / (1 + np.exp(-(z @ fit.weights[k, :-1] + fit.weights[k, -1])))
            gradient = np.append(z.T @ (p - y[mine]) + fit.weights[k, :-1] / 0.1, (p - y[mine]).sum())
            assert np.abs(gradient).max() < 1e-3
            first = z[:, 0]  # scaled on the other folds
            assert abs(first.mean()) < 1e-9 and first.std() == pytest.approx(1)


def test_target_means_leave_out_both_folds(rows):
    table = joint_cv.prepared(rows, "id", "y", "fold", ["town"])
    table.mean = None
    known = [r for r in rows.collect() if r["y"] is not None]
    r = next(r for r in known if r["fold"] == 2)
    row = table.rows.where(F.col("id") == r["id"]).first()
    for left_out in (1, 2, 4):
        use = [q for q in known if q["fold"] not in (left_out, 2)]
        same = [q["y"] for q in use if q["town"] == r["town"]]
        prior = np.mean([q["y"] for q in use])
        got = joint_cv._inputs(table, left_out - 1, np.array([1]), np.zeros((1, 0)), np.zeros((1, 0)), np.array([row["t"]]))[0, 0]
        assert got == pytest.approx((sum(same) + 10 * prior) / (len(same) + 10))


def test_many_levels(spark):
    many = spark.range(30000).select("id", F.concat(F.lit("level "), "id").alias("code"), (F.col("id") % 7).cast("double").alias("x"),
                                     (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2 + 1).cast("int").alias("fold"))
    table = joint_cv.prepared(many, "id", "y", "fold", ["code", "x"])
    scores = joint_cv.out_of_fold(table, joint_cv.fit_logistic(table, {"all": ["code", "x"]}))
    assert scores.where("`all` BETWEEN 0 AND 1").count() == 30000


def test_stored_scores_are_not_fitted_again(spark, rows):
    path = fresh_folder(spark, "oof")
    assert runner.run_or_load_sets(spark, path, SETS, rows, "y") == 15
    assert runner.run_or_load_sets(spark, path, SETS, rows, "y") == 0
    inputs = learners.Inputs(["b"])
    made = []

    def make():
        made.append(1)
        if len(made) == 3:
            raise RuntimeError("broken off")
        return learners.decision_tree(inputs, 3, 20)

    known = rows.where("y IS NOT NULL")
    with pytest.raises(RuntimeError):
        runner.run_or_load(spark, path, "tree", make, known, "y")
    assert runner.run_or_load(spark, path, "tree", make, known, "y") == 3  # two folds were stored
    scores = runner.stored_scores(spark, path)
    got = {r["model"]: (r["n"], r["ids"]) for r in scores.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()}
    assert got == {name: (1500, 1500) for name in [*SETS, "tree"]}
    names = [*SETS, "tree"]
    results = {r["model"]: r for r in runner.model_results(scores, names, n_boot=100).collect()}
    assert len(results) == 4 and all(r["roc_auc_low"] < r["roc_auc"] < r["roc_auc_high"] and r["fold_std"] >= 0 for r in results.values())
    steps = runner.ablation_table(scores, list(SETS), n_boot=100).collect()
    assert [r["step"] for r in steps] == list(SETS) and steps[0]["gain"] is None
    assert steps[1]["gain"] == pytest.approx(results["two / b"]["roc_auc"] - results["one"]["roc_auc"])
    assert steps[1]["gain_low"] > 0 and steps[1]["significant"] == 1  # b carries half of the signal
    assert steps[2]["significant"] == 0  # colour and town carry none
