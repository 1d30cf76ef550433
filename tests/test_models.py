"""Models, neighbours, contributions and what-if scoring: invariants and brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendframe.functions.nulls import safe_corr
from lendframe.models import learners, moments, runner
from lendframe.operators import contributions, encoders, neighbours, oversample, woe
from lendframe.plans import what_if
from lendframe.plans.application import application_features
from lendframe.plans.adapters import view
from lendframe.session import fresh_folder
from lendframe.sources import tables


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1200):
        a, b = rng.normal(), rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(1.5 - 1.2 * a)))
        rows.append((i, float(a), None if i % 10 == 0 else float(b), "red" if a + rng.normal() > 0 else ("blue" if i % 7 else None), y,
                     i % 3 + 1))
    return spark.createDataFrame(rows, "id long, a double, b double, colour string, y int, fold int").cache()


INPUTS = learners.Inputs(["a", "b"], ["colour"])


@pytest.mark.parametrize("make", [
    learners.dummy, lambda: learners.logistic_regression(INPUTS), lambda: learners.decision_tree(INPUTS, 4, 20),
    lambda: learners.boosted_trees(INPUTS, n_trees=5, learning_rate=0.2), lambda: learners.random_forest(INPUTS, 10, 5),
    lambda: learners.WoeScorecard(INPUTS), lambda: learners.NaiveBayes(INPUTS),
    lambda: learners.NaiveBayes(INPUTS, components=2), lambda: learners.AdaBoost(INPUTS, rounds=6, cut_every=2),
    lambda: learners.LinearMargin(INPUTS), lambda: learners.NystroemMargin(INPUTS, landmarks=20),
    lambda: learners.LayeredNet(INPUTS, hidden=(4,), max_iter=30)],
    ids=["prior", "logistic", "tree", "boosted", "forest", "scorecard", "bayes", "bayes pca", "adaboost", "svm", "rbf", "net"])
def test_every_learner_gives_probabilities(toy, make):
    scored = make().fit(toy.where("fold <> 1"), "y").transform(toy.where("fold = 1"))
    r = scored.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("p").alias("n"), safe_corr(F.col("p"), F.col("y")).alias("c")).first()
    assert 0 <= r["lo"] <= r["hi"] <= 1 and r["n"] == toy.where("fold = 1").count()
    assert r["c"] is None or r["c"] > 0.1 or abs(r["c"]) < 1e-9


LARGE = learners.Inputs(["a", "b"], ["colour"], ["town"])


@pytest.mark.parametrize("make", [
    learners.dummy, lambda: learners.logistic_regression(LARGE), lambda: learners.boosted_trees(LARGE, n_trees=5, learning_rate=0.2),
    lambda: learners.WoeScorecard(LARGE), lambda: learners.NaiveBayes(LARGE, components=2), lambda: learners.AdaBoost(LARGE, rounds=3),
    lambda: learners.LinearMargin(LARGE), lambda: learners.NystroemMargin(LARGE, landmarks=15),
    lambda: learners.LayeredNet(LARGE, hidden=(4,), max_iter=20)],
    ids=["prior", "logistic", "boosted", "scorecard", "bayes pca", "adaboost", "svm", "rbf", "net"])
def test_a_loaded_model_gives_the_same_scores(spark, toy, make):
    from lendframe.models.store import load_model, save_model
    rows = toy.withColumn("town", F.when(F.col("id") % 11 > 0, F.concat(F.lit("town "), F.col("id") % 31)))
    new = rows.where("fold = 1").withColumn("town", F.when(F.col("id") % 5 == 0, "never seen").otherwise(F.col("town")))
    fitted, path = make().fit(rows.where("fold <> 1"), "y"), fresh_folder(spark, "model")
    save_model(spark, fitted, path)
    loaded = load_model(spark.newSession(), path)
    before = {r["id"]: r["p"] for r in fitted.transform(new).collect()}
    assert len(before) == new.count() and {r["id"]: r["p"] for r in loaded.transform(new).collect()} == before


def test_thirty_thousand_levels_fit_and_score(spark):
    many = spark.range(30000).select("id", F.concat(F.lit("level "), "id").alias("code"), (F.col("id") % 7).cast("double").alias("x"),
                                     (F.col("id") % 3 == 0).cast("int").alias("y"))
    inputs = learners.Inputs(["x"], [], ["code"])
    for make in (lambda: learners.logistic_regression(inputs), lambda: learners.decision_tree(inputs, 3, 20)):
        assert make().fit(many, "y").transform(many).where("p BETWEEN 0 AND 1").count() == 30000
    numbers = encoders.level_numbers(many, "code").agg(F.countDistinct("value").alias("n"), F.max("value").alias("m")).first()
    assert numbers["n"] == 30000 and numbers["m"] == 29999


def test_out_of_fold_covers_every_row_once(toy):
    scored = runner.out_of_fold(lambda: learners.decision_tree(INPUTS, 3, 20), toy, "y", folds=(1, 2, 3))
    assert scored.count() == toy.count() == scored.select("id").distinct().count()


def test_newton_logistic_matches_a_local_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    model = moments.fit_newton_logistic(df, ["a", "b"], "y", C=1.0)
    beta = np.array([*model["coef"], model["intercept"]])
    x1 = np.hstack([x, np.ones((800, 1))])
    p = 1 / (1 + np.exp(-x1 @ beta))
    assert np.abs(x1.T @ (p - y) + np.array([1, 1, 0]) * beta).max() < 1e-5 and model["steps"] <= 12
    r = df.select(*[e.alias(n) for n, e in moments.laplace_columns(model).items()]).agg(
        F.min("logit_std").alias("s"), F.max(F.abs(F.col("p") - 0.5) - F.abs(1 / (1 + F.exp(-F.col("logit"))) - 0.5)).alias("d")).first()
    assert r["s"] > 0 and r["d"] <= 1e-12  # the corrected probability is never further from one half


def test_pca_lda_and_bayes_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, .5, .3]]) + 5
    y = (x[:, 0] + rng.normal(size=400) > 5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int")
    pca = moments.fit_pca(df, ["a", "b", "c"])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert pca["variance"] == pytest.approx(values) and sum(pca["share"]) == pytest.approx(1)
    spread = df.select(*[e.alias(n) for n, e in moments.pca_columns(pca).items()]).agg(
        F.avg("pc1").alias("m"), F.var_samp("pc1").alias("v")).first()
    assert spread["m"] == pytest.approx(0, abs=1e-9) and spread["v"] == pytest.approx(values[0])
    lda = moments.fit_lda(df, ["a", "b", "c"], "y")
    means = np.array([x[y == k].mean(axis=0) for k in (0, 1)])
    within = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in (0, 1)) / 400
    direction = np.linalg.solve(within, means[1] - means[0])
    got = np.array(lda["axes"][0])
    assert abs(got @ direction) / np.linalg.norm(got) / np.linalg.norm(direction) == pytest.approx(1)
    bayes = moments.fit_naive_bayes(df, ["a", "b", "c"], "y")
    assert bayes["classes"][1]["mean"] == pytest.approx(list(means[1]))


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(700, 4))
    points[:230] = points[0]  # a third of the points coincide
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(df, df, 4, same=True).collect():
        got.setdefault(r["qid"], []).append(r["d"])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    assert len(got) == 700
    assert max(np.abs(np.sort(got[i]) - want[i]).max() for i in range(700)) < 1e-6


def test_neighbours_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "POINTS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(4)
    points, queries = rng.normal(size=(300, 3)), rng.normal(size=(50, 3))
    as_df = lambda a: spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(a)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(as_df(points), as_df(queries), 5).collect():
        got.setdefault(r["qid"], []).append(r["d"])
    want = np.sort(np.sqrt(((queries[:, None] - points[None]) ** 2).sum(axis=2)), axis=1)[:, :5]
    assert max(np.abs(np.sort(got[i]) - want[i]).max() for i in range(50)) < 1e-6


def test_synthetic_positives_lie_between_their_parents(toy):
    ready = toy.where("b IS NOT NULL").withColumn("code", (F.col("id") % 4).cast("int"))
    pos, neg = ready.where("y = 1").count(), ready.where("y = 0").count()
    ratio = (pos + 150) / neg
    made = oversample.synthetic_positives(ready, "id", "y", ["a", "b"], ["code"], ratio=ratio, k=3).toPandas()
    assert len(made) == round(ratio * neg) - pos and made["gap"].between(0, 1).all()
    real = ready.toPandas().set_index("id")
    base, partner = real.loc[made["base"]], real.loc[made["partner"]]
    want = base["a"].to_numpy() + made["gap"].to_numpy() * (partner["a"].to_numpy() - base["a"].to_numpy())
    assert np.allclose(want, made["a"]) and (base["y"] == 1).all() and (partner["y"] == 1).all()
    assert (made["code"].to_numpy() == np.where(made["gap"] > .5, partner["code"], base["code"])).all()


def test_tree_contributions_add_up_and_match_the_shapley_formula(toy):
    fitted = learners.boosted_trees(INPUTS, n_trees=4, learning_rate=0.3, depth=3, subsample=1.0).fit(toy, "y")
    model = fitted.model.stages[1]
    long = contributions.tree_contributions(fitted.ready(toy), "id", fitted.columns, model)
    base = contributions.expected_value(contributions.read_trees(model), 2.0)
    total = long.groupBy("id").agg((F.sum("impact") + F.lit(base)).alias("z"))
    worst = total.join(fitted.transform(toy), on="id").agg(
        F.max(F.abs(F.col("z") - F.log(F.col("p") / (1 - F.col("p"))))).alias("d")).first()["d"]
    assert worst < 1e-6


def test_linear_contributions_and_reasons(spark):
    df = spark.createDataFrame([(1, 2.0, -1.0, 0.5), (2, -3.0, 0.0, 0.0)], "id int, a double, b double, c double")
    impacts = contributions.linear_contributions({c: F.col(c) for c in "abc"}, [1.0, 2.0, -1.0], [0.0, 0.0, 0.0])
    out = df.withColumn("impacts", impacts).withColumns(contributions.top_reasons(F.col("impacts"), 2)).orderBy("id").collect()
    assert [r["feature"] for r in out[0]["raises"]] == ["a"] and [r["feature"] for r in out[0]["lowers"]] == ["b", "c"]
    assert out[1]["raises"] == [] and out[1]["lowers"][0]["impact"] == -3.0


def test_scorecard_points_add_up(toy):
    rules = woe.fit_woe(toy, "y", ["a", "b"], ["colour"], min_iv=0.0)
    points = woe.scorecard_points(rules, [-0.9] * len(rules), -1.0)
    rows = toy.withColumns({"score": woe.score_column(rules, points), **woe.woe_columns(rules)})
    factor = 20 / np.log(2)
    z = F.lit(-1.0)
    for c in rules:
        z = z + F.lit(-0.9) * F.col(f"{c}_woe")
    want = F.lit(600 - factor * np.log(50)) - F.lit(factor) * z
    assert rows.agg(F.max(F.abs(F.col("score") - want))).first()[0] < 1e-8


def test_woe_sends_unseen_text_to_missing_without_an_other_bin(toy):
    rules = woe.fit_woe(toy, "y", [], ["colour"], min_iv=0.0)
    df = toy.limit(1).withColumn("colour", F.lit("green")).withColumns(woe.woe_columns(rules))
    assert df.first()["colour_woe"] == pytest.approx(rules["colour"]["woe"]["(missing)"])


def test_what_if_without_changes_gives_the_stored_features(spark, sf_dir):
    raw = view(spark, sf_dir, "application")
    stored = application_features(raw).withColumns({c: F.lit(None).cast("double") for c in (
        "BUR_ACTIVE_DEBT_TOTAL", "BUR_ACTIVE_ANNUITY_TOTAL", "PREV_CREDIT_MEAN")})
    none = raw.select("SK_ID_CURR", *[F.lit(None).cast("double").alias(f) for f in what_if.FIELDS])
    again = what_if.rebuilt_features(what_if.overlay(raw, none), stored)
    cols = sorted(c for c in stored.columns if c.startswith("APP_"))
    assert again.select("SK_ID_CURR", *cols).exceptAll(stored.select("SK_ID_CURR", *cols)).count() == 0
    assert again.count() == stored.count()


def test_search_resumes_and_refuses_other_candidates(spark, tmp_path):
    calls = []

    def score(params):
        calls.append(params["k"])
        return params["k"] / 10, params["k"]
    path = str(tmp_path / "trials")
    runner.run_search(spark, "grid", [{"k": 3}, {"k": 1}], score, path)
    table = runner.run_search(spark, "grid", [{"k": 3}, {"k": 1}, {"k": 5}], score, path).orderBy("trial").collect()
    assert calls == [3, 1, 5] and [r["best_so_far"] for r in table] == [0.3, 0.3, 0.5]
    with pytest.raises(ValueError):
        runner.run_search(spark, "grid", [{"k": 9}], score, path)


def test_narrow_types(spark):
    df = spark.createDataFrame([(100001, 1, -20000, 1.5, "x"), (456255, 0, -100, 2.5, "y")],
                               "id long, target long, days long, amount double, name string")
    assert dict(tables.shrink(df).dtypes) == {"id": "int", "target": "tinyint", "days": "smallint", "amount": "float",
                                              "name": "string"}


def test_stored_scores_must_cover_the_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.6)], "id long, p double")
    tables.write_scores(df, str(tmp_path), "m")
    assert [r["id"] for r in tables.load_scores(spark, str(tmp_path), "m", df.select("id")).collect()] == [1, 2]
    with pytest.raises(ValueError):
        tables.load_scores(spark, str(tmp_path), "m", spark.createDataFrame([(3,)], "id long"))


def test_moments_far_from_zero_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [1.0, 0.1] + 1e8
    df = spark.createDataFrame([(float(a), float(b), int(i % 2)) for i, (a, b) in enumerate(x)], "a double, b double, y int")
    want = np.sort(np.linalg.eigvalsh(np.cov((x - x.mean(0)).T)))[::-1]
    assert np.allclose(moments.fit_pca(df, ["a", "b"])["variance"], want, rtol=1e-4)
    assert np.isfinite(moments.fit_lda(df, ["a", "b"], "y")["axes"]).all()


def test_rows_that_tell_when_to_stop_teach_nothing(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4), i % 2 == 0) for i in range(400)], "id long, x double, y int, is_check boolean")
    make = lambda: learners.boosted_trees(learners.Inputs(["x"]), n_trees=3, learning_rate=0.3, depth=2, validation="is_check")
    far = rows.withColumn("x", F.when(F.col("is_check"), F.col("x") + 1e6).otherwise(F.col("x")))
    assert make().fit(far, "y").inputs == make().fit(rows, "y").inputs  # the same medians


def test_target_encoding_does_not_leak_the_label(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, f"l{rng.integers(3000)}", int(rng.integers(2)), float(rng.random())) for i in range(6000)],
                                 "id long, level string, y int, x double").repartition(4)
    learner = learners.logistic_regression(learners.Inputs(["x"], [], ["level"]))
    learned, train = learner.training(rows, "y")
    inside, columns = learners.inputs_of(learned, crossed=True), learners.inputs_of(learned)
    rate = learners.with_levels(train, learned).select("id", "y", inside["level_rate"].alias("crossed"), columns["level_rate"].alias("whole"))
    got = rate.agg(F.countDistinct("id").alias("n"), F.corr("y", "crossed").alias("crossed"), F.corr("y", "whole").alias("whole")).first()
    assert got["n"] == 6000
    assert abs(got["crossed"]) < 0.1 and got["whole"] > 0.3


def test_joint_kmeans_is_lloyds_algorithm(spark):
    from lendframe.operators import clusters
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 3)) + c for c in ([0, 0, 0], [6, 0, 0], [0, 7, 0])] + [np.zeros((100, 3))])
    df = spark.createDataFrame([(i, [float(u) for u in r]) for i, r in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    found = clusters.joint_kmeans(df, [1, 2, 3, 4], n_init=3)
    assert found[1][0] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    for k, (inertia, centres) in found.items():
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert inertia == pytest.approx(d.min(1).sum())
        means = np.array([x[d.argmin(1) == j].mean(0) for j in range(k)])
        assert np.abs(means - centres).max() < 0.1
    assert found[3][0] < 0.35 * found[2][0]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "id long, v array<double>")
    assert list(clusters.joint_kmeans(same, [1, 2])) == [1]  # only one different row to start from
    assert clusters.joint_kmeans(df.where("id < 0"), [2]) == {}


def test_neighbour_vote_chain(spark, toy):
    """Selection, components and vote against the same steps in NumPy on the fitted inputs."""
    fitted = learners.NeighbourVote(LARGE, select=3, components=2, k=25).fit(
        toy.withColumn("town", F.concat(F.lit("town "), F.col("id") % 31)).where("fold <> 1"), "y")
    held = toy.withColumn("town", F.concat(F.lit("town "), F.col("id") % 31)).where("fold = 1")
    points = spark.read.parquet(fitted.points).orderBy("id").collect()
    x, y, ids = np.array([r["v"] for r in points]), np.array([r["y"] for r in points]), np.array([r["id"] for r in points])
    asked = {r["id"]: np.array(r["v"]) for r in fitted.placed(held).collect()}
    got = {r["id"]: r["p"] for r in fitted.transform(held).collect()}
    assert len(got) == len(asked) == held.count() and x.shape[1] == 2
    for i, q in asked.items():
        d = np.sqrt(((x - q) ** 2).sum(1))
        assert got[i] == pytest.approx(y[np.lexsort((ids, d))[:25]].mean())


def test_fill_report_matches_numpy(spark):
    from lendframe.models import fill
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 3)) * [1, 1000, 5] + [0, 1e6, 3]
    x = np.hstack([x, x[:, :1] * 2 + 1])  # two columns that copy each other
    t = x[:, 0] * 0.4 + x[:, 1] / 2000 + rng.normal(size=800)
    hole, fold = rng.random(800) < 0.2, np.arange(800) % 5 + 1
    data = [(int(fold[i]), None if i % 7 == 0 else float(t[i]), None if hole[i] else float(x[i, 0]), *map(float, x[i, 1:])) for i in range(800)]
    df = spark.createDataFrame(data, "fold int, t double, a double, b double, c double, d double")
    got = {(r["method"], r["penalty"]): r for r in fill.fill_report(df, "t", ["a", "b", "c", "d"]).collect()}
    known = np.arange(800) % 7 != 0
    fit, check = known & (fold != 1), known & (fold == 1)
    z = x.copy()
    middle = df.where("fold <> 1 AND t IS NOT NULL").agg(F.percentile_approx("a", 0.5, 2000)).first()[0]
    z[hole, 0] = middle
    z = (z - z[fit].mean(0)) / z[fit].std(0)
    mean, total = t[fit].mean(), ((t[check] - t[check].mean()) ** 2).sum()
    for penalty in (0.01, 1.0, 100.0):
        w = np.linalg.solve(z[fit].T @ z[fit] + penalty * np.eye(4), z[fit].T @ (t[fit] - mean))
        left = t[check] - mean - z[check] @ w
        r = got[("ridge", penalty)]
        assert r["rmse"] == pytest.approx(np.sqrt((left**2).mean())) and r["r2"] == pytest.approx(1 - (left**2).sum() / total)
        assert r["largest_weight"] == pytest.approx(np.abs(w).max())
    left = t[check] - np.median(t[fit])
    assert got[("median", None)]["rmse"] == pytest.approx(np.sqrt((left**2).mean()))
    assert got[("least squares", 0.0)]["r2"] > 0.2 and sum(r["chosen"] for r in got.values()) == 1
    assert fill.fill_report(df.where("t > 1e9"), "t", ["a"]).count() == 0


def test_individual_curves_and_their_mean(toy):
    fitted = learners.decision_tree(INPUTS, 3, 20).fit(toy, "y")
    grid = [-1.0, 0.0, 2.0]
    curves = {r["id"]: list(r["scores"]) for r in contributions.individual_curves(fitted, toy, "id", "a", grid).collect()}
    for i, v in enumerate(grid):
        whole = {r["id"]: r["p"] for r in fitted.transform(toy.withColumn("a", F.lit(v))).collect()}
        assert {k: c[i] for k, c in curves.items()} == whole
    mean = {r["grid_value"]: r["mean_p"] for r in contributions.partial_dependence(fitted, toy, "a", grid).collect()}
    assert mean[2.0] == pytest.approx(np.mean([c[2] for c in curves.values()])) and len(curves) == toy.count()
