"""Models, cross-validation, search, calibration and neighbours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lendframe.models import fill, joint_cv, learners, moments, runner
from lendframe.operators import encoders, metrics, neighbours, oversample
from lendframe.operators.fairness import reweighing
from lendframe.operators.ranking import hash_rank
from lendframe.plans.adapters import raw, view
from lendframe.plans.feature_table import FAMILIES, family_columns
from lendframe.queries.encoding import LABELLED, MODEL_INPUTS, model_rows, rows_to_fit
from lendframe.queries.features import features
from lendframe.queries.registry import add
from lendframe.queries.sampling import hash_sql, hex_sql
from lendframe.operators.joins import beside
from lendframe.session import fresh_folder

APP = ["application"]
FEW = learners.Inputs(["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_1", "EXT_SOURCE_2"], ["NAME_EDUCATION_TYPE"])


def halves(s, d):
    rows = rows_to_fit(s, d)
    return rows.where("fold <> 1"), rows.where("fold = 1")


def held_scores(make):
    """Train on four folds, score the fifth."""
    def run(s, d):
        train, held = halves(s, d)
        return make().fit(train, "y").transform(held).select("id", "y", "p")
    return run


P = "i:id,y d6:p"
add("md_1_prior", P, held_scores(learners.dummy),
    f"""SELECT SK_ID_CURR AS id, TARGET AS y, (SELECT avg(y) FROM folded WHERE fold <> 1) AS p FROM folded WHERE fold = 1""",
    APP, f"folded AS (SELECT *, TARGET AS y, {hex_sql(hash_sql('SK_ID_CURR', 42))} % 5 + 1 AS fold FROM {LABELLED})")
add("md_2_logistic_regression", P, held_scores(lambda: learners.logistic_regression(MODEL_INPUTS)))
add("md_3_woe_scorecard", P, held_scores(lambda: learners.WoeScorecard(MODEL_INPUTS, min_iv=0.0)))
add("md_4_naive_bayes_pca", P, held_scores(lambda: learners.NaiveBayes(MODEL_INPUTS, components=5)))
add("md_5_decision_tree", P, held_scores(lambda: learners.decision_tree(MODEL_INPUTS)))
add("md_6_boosted_trees", P, held_scores(lambda: learners.boosted_trees(MODEL_INPUTS, n_trees=10, learning_rate=0.2)))
add("md_7_random_forest", P, held_scores(lambda: learners.random_forest(MODEL_INPUTS)))
add("md_8_linear_svm", P, held_scores(lambda: learners.LinearMargin(MODEL_INPUTS)))
add("md_11_adaboost", P, held_scores(lambda: learners.AdaBoost(FEW, rounds=6)))
add("md_12_layered_net", P, held_scores(lambda: learners.LayeredNet(MODEL_INPUTS)))


# ---------------------------------------------------------------- naive Bayes, checked exactly
LINE_COLS = ["l_quantity", "l_discount", "l_tax"]


def _lines(s, d):
    return raw(s, d, "lineitem").select(*LINE_COLS, (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _bayes(s, d):
    model = moments.fit_naive_bayes(_lines(s, d), LINE_COLS, "y")
    scored = _lines(s, d).withColumn("logit", moments.naive_bayes_logit(model))
    return scored.groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"), F.avg("logit").alias("logit"))


_EPS = "1e-9 * (SELECT greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) FROM lines)"
_JOINT = " + ".join(f"(-0.5e0 * ln(2 * pi() * v_{c}) - pow(l.{c} - m_{c}, 2) / (2 * v_{c}))" for c in LINE_COLS)
add("md_4_naive_bayes", "d2:l_quantity,l_discount i:n d6:logit", _bayes,
    f"""SELECT l_quantity, l_discount, count(*) AS n, avg(logit) AS logit FROM (
        SELECT l.l_quantity, l.l_discount, l.id, sum(CASE WHEN c.y = 1 THEN 1 ELSE -1 END * (ln(prior) + {_JOINT})) AS logit
        FROM lines l, classes c GROUP BY 1, 2, 3) GROUP BY 1, 2""", (),
    f"""lines AS (SELECT row_number() OVER () AS id, {', '.join(LINE_COLS)}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
classes AS (SELECT y, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lines) AS prior,
  {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) + {_EPS} AS v_{c}' for c in LINE_COLS)} FROM lines GROUP BY 1)""")


def _rbf(s, d):
    train, held = halves(s, d)
    return learners.NystroemMargin(MODEL_INPUTS, landmarks=60).fit(train, "y").transform(held).select("id", "y", "p")


add("md_9_rbf_svm", P, _rbf)


def vectors(s, d):
    return raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
                                          "label")


def _knn(s, d):
    rows = vectors(s, d).withColumn("y", (F.col("label") < 5).cast("int"))
    train, held = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    return neighbours.vote(train, train, held, k=15)


_DIST = "list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2)))"
add("md_10_knn_vote", "i:id d6:p", _knn,
    f"""SELECT id, avg(y) AS p FROM (SELECT q.vec_id AS id, CASE WHEN e.label < 5 THEN 1 ELSE 0 END AS y,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS r
        FROM embeddings q, embeddings e WHERE q.vec_id % 5 = 0 AND e.vec_id % 5 <> 0) WHERE r <= 15 GROUP BY 1""")


def feature_inputs(rows, name="id", label="y"):
    """All columns of the feature table by kind."""
    texts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string" and f.name.startswith(tuple(FAMILIES))]
    large = [c for c in texts if c.endswith("ORGANIZATION_TYPE")]
    return learners.Inputs([c for c in rows.columns if c.startswith(tuple(FAMILIES)) and c not in texts], [c for c in texts if c not in large], large)


def _knn_chain(s, d):
    """Selection, principal components and a vote of 200, on the feature table."""
    rows = encoders.stored(feature_rows(s, d), "features")  # read by every fit
    train, held = rows.where("fold <> 1"), rows.where("fold = 1")
    scored = learners.NeighbourVote(feature_inputs(rows)).fit(train, "y").transform(held)
    votes = F.col("p") * F.lit(min(200, train.count()))
    return scored.select("id", "y", (F.abs(votes - F.round(votes)) < 1e-6).cast("int").alias("whole_votes"))


add("md_10_knn_chain", "i:id,y,whole_votes", _knn_chain, "SELECT id, y, 1 AS whole_votes FROM folded WHERE fold = 1", APP,
    f"folded AS (SELECT SK_ID_CURR AS id, TARGET AS y, {hex_sql(hash_sql('SK_ID_CURR', 42))} % 5 + 1 AS fold FROM {LABELLED})")
add("jn_9_nearest_neighbours", "i:qid,rank d:d",
    lambda s, d: neighbours.nearest(vectors(s, d).select("id", "v"), vectors(s, d).select("id", "v"), 5, same=True),
    f"""SELECT qid, rank, sqrt(d2) AS d FROM (SELECT q.vec_id AS qid, {_DIST} AS d2,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE rank <= 5""")


def _smote(s, d):
    rows = model_rows(s, d)
    numeric = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_2"]
    scale = encoders.fit_scaler(rows, {c: F.col(c).cast("double") for c in numeric})
    ready = rows.select("id", "y", "CNT_CHILDREN", *[((F.col(c) - scale[c][0]) / scale[c][1]).alias(c) for c in numeric])
    return oversample.synthetic_positives(ready, "id", "y", numeric, ["CNT_CHILDREN"], ratio=0.8)


add("spl_4_synthetic_positives", "i:base,partner,CNT_CHILDREN d:gap,AMT_INCOME_TOTAL,AMT_CREDIT,EXT_SOURCE_2", _smote)


# ---------------------------------------------------------------- Newton logistic, Laplace, LDA, PCA
def _standard(s, d):
    rows = view(s, d, "scores").select("id", "y", ((F.col("p") - 0.4) * 4).alias("a"), ((F.col("p2") - 0.4) * 4).alias("b"))
    return rows


def _newton(s, d):
    model = moments.fit_newton_logistic(_standard(s, d), ["a", "b"], "y")
    return _standard(s, d).select("id", moments.newton_probability(model).alias("p"), F.lit(model["steps"]).alias("steps"))


add("md_13_newton_logistic", "i:id,steps d6:p", _newton)


def _laplace(s, d):
    model = moments.fit_newton_logistic(_standard(s, d), ["a", "b"], "y")
    return _standard(s, d).select("id", *[e.alias(n) for n, e in moments.laplace_columns(model).items()])


add("md_14_laplace", "i:id d6:logit,logit_std,p", _laplace)
DIMS = 64  # all positions of the vectors


def _wide(s, d):
    return vectors(s, d).select("id", "label", *[F.col("v")[i].alias(f"v{i}") for i in range(DIMS)])


def _lda(s, d):
    model = moments.fit_lda(_wide(s, d), [f"v{i}" for i in range(DIMS)], "label")
    return _wide(s, d).select("id", *[e.alias(n) for n, e in list(moments.lda_columns(model).items())[:2]],
                              moments.lda_class(model).alias("label"))


add("md_15_lda", "i:id,label d:lda1,lda2", _lda)


def _pca(s, d):
    model = moments.fit_pca(_wide(s, d), [f"v{i}" for i in range(DIMS)], 3)
    return _wide(s, d).select("id", *[e.alias(n) for n, e in moments.pca_columns(model).items()])


add("md_16_pca", "i:id d:pc1,pc2,pc3", _pca)


def _fill_score(s, d):
    """The first external score from all other numbers of the feature table, without those made of it."""
    rows = features(s, d).withColumn("fold", (encoders.hash_fold("SK_ID_CURR", 5) + 1).cast("int"))
    kept = ("APP_EXT_SOURCE_2", "APP_EXT_SOURCE_3")
    inputs = [f.name for f in rows.schema.fields if f.dataType.typeName() != "string" and f.name.startswith(tuple(FAMILIES))
              and (not f.name.startswith("APP_EXT_") or f.name in kept)]
    needed = rows.select("fold", "APP_EXT_SOURCE_1", *inputs).where("APP_EXT_SOURCE_1 IS NOT NULL")
    rows = encoders.stored(needed, "fill-rows")  # read in several passes
    return fill.fill_report(rows, "APP_EXT_SOURCE_1", inputs)


REPORT = "s:method i:chosen d4:penalty,rmse,r2,largest_weight"
add("md_17_ridge", REPORT, _fill_score)


def _fill_by_one(s, d):
    rows = view(s, d, "application").withColumn("fold", (encoders.hash_fold("SK_ID_CURR", 5) + 1).cast("int"))
    return fill.fill_report(rows, "EXT_SOURCE_1", ["EXT_SOURCE_2"]).drop("chosen")


add("md_17_one_input", "s:method d6:penalty,rmse,r2,largest_weight", _fill_by_one,
    """SELECT method, penalty, sqrt(avg(pow(y - guess, 2))) AS rmse, 1 - sum(pow(y - guess, 2)) / sum(pow(y - my, 2)) AS r2, max(abs(w)) AS largest_weight
       FROM (SELECT method, penalty, w, y, CASE WHEN method = 'median' THEN middle ELSE ymean + w * (x - xmean) / xsd END AS guess,
         avg(y) OVER (PARTITION BY method, penalty) AS my FROM folded, fit, tried WHERE fold = 1) GROUP BY 1, 2""", APP,
    f"""folded AS (SELECT EXT_SOURCE_2 AS x, EXT_SOURCE_1 AS y, {hex_sql(hash_sql('SK_ID_CURR', 42))} % 5 + 1 AS fold FROM application
      WHERE EXT_SOURCE_1 IS NOT NULL),
    fit AS (SELECT avg(x) AS xmean, stddev_pop(x) AS xsd, avg(y) AS ymean, count(*) AS n, covar_pop(x, y) / stddev_pop(x) AS xy,
      quantile_cont(y, 0.5e0) AS middle FROM folded WHERE fold <> 1),
    tried AS (SELECT method, penalty, CASE method WHEN 'median' THEN NULL ELSE n * xy / (n + penalty) END AS w FROM fit, (
      SELECT 'median' AS method, CAST(NULL AS DOUBLE) AS penalty UNION ALL SELECT 'least squares', 0e0
      UNION ALL SELECT 'ridge', unnest([{', '.join(f'{a!r}e0' if 'e' not in repr(a) else repr(a) for a in fill.PENALTIES)}])))""")


def _weighted(s, d):
    train, held = halves(s, d)
    weighted = reweighing(train, "y", "CODE_GENDER")
    return learners.logistic_regression(MODEL_INPUTS).fit(weighted, "y", "weight").transform(held).select("id", "y", "p")


add("md_18_weighted_fit", P, _weighted)


# ---------------------------------------------------------------- runner
# The ablation adds one source table after the other
STEPS = {"main table": ["APP_"], "+ bureau": ["BUR_", "BB_"], "+ previous": ["PREV_"], "+ installments": ["INST_"], "+ POS/cash": ["POS_"],
         "+ credit cards": ["CC_"]}


def feature_rows(s, d):
    """The feature table with id, y and fold: all columns, labelled applicants."""
    rows = features(s, d).where("TARGET IS NOT NULL").withColumn("fold", (encoders.hash_fold("SK_ID_CURR", 5) + 1).cast("int"))
    return rows.withColumnsRenamed({"SK_ID_CURR": "id", "TARGET": "y"})


def nested_sets(columns):
    """Step -> its feature columns and those of all steps before it."""
    families, out = [], {}
    for step, more in STEPS.items():
        families += more
        out[step] = family_columns(columns, families)
    return out


def _scores_of_steps(s, d, steps):
    rows, path = feature_rows(s, d), fresh_folder(s, "oof")
    sets = nested_sets(rows.columns)
    runner.run_or_load_sets(s, path, {n: sets[n] for n in steps}, rows, "y")
    return path, sets


LAST = list(STEPS)[-1]
FOLDED = f"folded AS (SELECT SK_ID_CURR AS id, TARGET AS y, {hex_sql(hash_sql('SK_ID_CURR', 42))} % 5 + 1 AS fold FROM {LABELLED})"


def _cv(s, d):
    path, _ = _scores_of_steps(s, d, [LAST])
    return runner.stored_scores(s, path, [LAST])


add("ev_12_out_of_fold", "i:id,fold,y d6:p", _cv)


def _stored(s, d):
    """Every row is scored once, by the model without its fold; a second run makes no fit."""
    path, sets = _scores_of_steps(s, d, [LAST])
    again = runner.run_or_load_sets(s, path, {LAST: sets[LAST]}, feature_rows(s, d), "y")
    return runner.stored_scores(s, path).groupBy("id").agg(
        F.max("fold").alias("fold"), F.max("y").alias("y"), F.count("*").alias("times"),
        F.max(F.col("p").between(0, 1).cast("int")).alias("inside")).withColumn("fits_of_second_run", F.lit(again))


add("ev_12_stored_scores", "i:id,fold,y,times,inside,fits_of_second_run", _stored,
    "SELECT id, fold, y, 1 AS times, 1 AS inside, 0 AS fits_of_second_run FROM folded", APP, FOLDED)


def _results(s, d):
    path, _ = _scores_of_steps(s, d, ["main table", LAST])
    return runner.model_results(runner.stored_scores(s, path), ["main table", LAST])


add("ev_7_model_results", "s:model i:n d6:roc_auc,roc_auc_low,roc_auc_high,fold_mean,fold_std,pr_auc,ks,brier,ece", _results)


def _ablation(s, d):
    path, sets = _scores_of_steps(s, d, STEPS)
    table = runner.ablation_table(runner.stored_scores(s, path), list(STEPS))
    sizes = F.create_map(*[F.lit(x) for n, c in sets.items() for x in (n, len(c))])
    return table.withColumn("features", sizes[F.col("step")])


add("ev_15_ablation", "s:step i:features,significant d6:roc_auc,low,high,gain,gain_low,gain_high", _ablation)


def _ablation_rows(s, d):
    path, _ = _scores_of_steps(s, d, STEPS)
    return runner.stored_scores(s, path).groupBy(F.col("model").alias("step"), "fold").agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.sum("y").alias("bad"))


add("ev_15_ablation_rows", "s:step i:fold,rows,ids,bad", _ablation_rows,
    f"""SELECT step, fold, count(*) AS rows, count(DISTINCT id) AS ids, sum(y) AS bad
        FROM folded, (SELECT unnest({list(STEPS)!r}) AS step) GROUP BY 1, 2""", APP, FOLDED)


def _optimum(s, d):
    """Logistic regression on the feature table: no part of a model's gradient is left."""
    rows = feature_rows(s, d)
    table = joint_cv.prepared(rows, "id", "y", "fold", nested_sets(rows.columns)[LAST])
    fit = joint_cv.fit_logistic(table, {LAST: table.inputs})[LAST]
    flat = s.createDataFrame([(k, int(fit.slope <= 1e-4), int(abs(fit.weights[i]).max() < 100)) for i, k in enumerate(table.folds)],
                             "fold int, flat int, bounded int")
    return rows.groupBy("fold").agg(F.count("*").alias("held_out")).join(flat, "fold")


add("md_2_feature_table", "i:fold,held_out,flat,bounded", _optimum,
    "SELECT fold, count(*) AS held_out, 1 AS flat, 1 AS bounded FROM folded GROUP BY 1", APP, FOLDED)


def _five_by_two(s, d):
    rows = model_rows(s, d)
    out = None
    for i in range(5):
        part = hash_rank(rows, "id", by=["y"], seed=42 + i).withColumn("fold", ((F.col("hash_rank") - 1) % 2).cast("int")).drop(
            "hash_rank", "group_rows").withColumn("repeat", F.lit(i))
        out = part if out is None else out.unionByName(part)
    r = runner.five_by_two_cv(lambda: learners.decision_tree(FEW, 4, 20), learners.dummy, out, "y")
    return s.createDataFrame([(r["t"], r["p_value"], r["mean_difference"])], "t double, p_value double, mean_difference double")


add("ev_11_five_by_two", "d6:t,p_value,mean_difference", _five_by_two)


add("ev_16_learning_curve", "d:share,train_auc,held_auc",
    lambda s, d: runner.learning_curve(lambda: learners.logistic_regression(MODEL_INPUTS), *halves(s, d), "id", "y", [0.2, 0.5, 1.0]))
add("tu_1_grid", "i:n,num_leaves,min_child_samples d:learning_rate", lambda s, d: raw(s, d, "region").agg(
    F.count("*").alias("n")).transform(beside, runner.grid_candidates(s)),
    """SELECT (SELECT count(*) FROM region) AS n, learning_rate, num_leaves, min_child_samples FROM
       (SELECT unnest([0.02e0, 0.05e0, 0.1e0]) AS learning_rate), (SELECT unnest([16, 48, 128]) AS num_leaves),
       (SELECT unnest([30, 150, 500]) AS min_child_samples)""")


def _u(name: str) -> str:
    return f"CAST('0x' || substr(md5(concat(CAST(trial AS VARCHAR), ':{name}', ':42')), 1, 8) AS BIGINT) / 4294967296e0"


def _draw(name: str) -> str:
    low, high, log, whole = runner.SPACE[name]
    value = f"exp(ln({low}e0) + {_u(name)} * (ln({high}e0) - ln({low}e0)))" if log else f"{low}e0 + {_u(name)} * ({high}e0 - {low}e0)"
    return f"{f'floor({value} + 0.5e0)' if whole else value} AS {name}"


add("tu_2_random_candidates", "i:trial,num_leaves,min_child_samples d6:learning_rate,subsample,colsample_bytree,reg_lambda",
    lambda s, d: runner.random_candidates(raw(s, d, "part").select(F.col("p_partkey").alias("trial"))),
    f"SELECT trial, {', '.join(_draw(n) for n in runner.SPACE)} FROM (SELECT p_partkey AS trial FROM part)")


def _holdout(s, d):
    rows = model_rows(s, d)
    score = runner.holdout_score(lambda p: learners.boosted_trees(
        FEW, n_trees=15, learning_rate=p["learning_rate"], depth=3, validation="is_check"), rows, "y")
    auc, trees = score({"learning_rate": 0.2})
    return s.createDataFrame([(float(auc), int(trees))], "auc double, trees int")


add("tu_3_holdout_score", "d:auc i:trees", _holdout)


def _search(s, d):
    """The whole grid: boosted trees on the training folds, judged on the fold left out; a second run scores nothing."""
    rows, path, scored = encoders.stored(model_rows(s, d), "search-rows"), fresh_folder(s, "search"), []
    judge = runner.holdout_score(lambda p: learners.boosted_trees(
        FEW, n_trees=8, learning_rate=p["learning_rate"], depth=int(math.log2(p["num_leaves"])), min_leaf=p["min_child_samples"],
        validation="is_check"), rows, "y")

    def score(params):
        scored.append(params)
        return judge(params)
    grid = [r.asDict() for r in runner.grid_candidates(s).orderBy("learning_rate", "num_leaves", "min_child_samples").collect()]
    runner.run_search(s, "grid", grid, score, path)
    first = len(scored)
    found = runner.run_search(s, "grid", grid, score, path)
    return found.withColumns({"first_run": F.lit(first), "second_run": F.lit(len(scored) - first),
                              "inside": ((F.col("auc") > 0) & (F.col("auc") <= F.col("best_so_far")) & (F.col("best_so_far") <= 1)).cast("int")})


add("tu_4_search", "s:method i:trial,first_run,second_run,inside", _search,
    f"""SELECT 'grid' AS method, trial, 27 AS first_run, 0 AS second_run, 1 AS inside FROM range(27) t(trial)
        WHERE (SELECT count(DISTINCT y) FROM folded) = 2""", APP, FOLDED)


def _open_trials(s, d):
    """Trials of the grid that are not done yet."""
    grid = raw(s, d, "part").select(F.col("p_partkey").alias("trial"), F.col("p_size").alias("size"))
    done = raw(s, d, "supplier").select(F.col("s_suppkey").alias("trial"))
    return grid.join(done, on="trial", how="left_anti")


add("src_10_open_trials", "i:trial,size", _open_trials,
    "SELECT p_partkey AS trial, p_size AS size FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")


def _scored(s, d):
    return view(s, d, "scores").withColumn("fold", encoders.hash_fold("id", 5))


add("cal_1_sigmoid", "i:id d6:calibrated", lambda s, d: runner.calibrate_sigmoid(_scored(s, d), "p", "y", "fold"))
add("cal_2_isotonic", "i:id d6:calibrated", lambda s, d: runner.calibrate_isotonic(_scored(s, d), "p", "y", "fold"))


def _proxy(s, d):
    """How well the model inputs predict the sensitive attribute, and from which columns."""
    rows = model_rows(s, d).withColumn("is_m", (F.col("CODE_GENDER") == "M").cast("int"))
    train, held = rows.where("fold <> 1"), rows.where("fold = 1")
    inputs = learners.Inputs(FEW.numeric + ["DAYS_BIRTH"], FEW.small)
    fitted = learners.boosted_trees(inputs, n_trees=8, learning_rate=0.2, depth=4).fit(train, "is_m")
    gains = fitted.model.stages[1].featureImportances.toArray()
    auc = metrics.rank_metrics(fitted.transform(held), "is_m", "p").select("roc_auc")
    table = s.createDataFrame([(n, float(g)) for n, g in zip(fitted.info["names"], gains)], "feature string, gain double")
    return table.transform(beside, auc).orderBy(F.desc("gain"), "feature").limit(10)


add("fa_7_proxy_test", "s:feature d:gain,roc_auc", _proxy)


def _saved(s, d):
    """Models written, read back and scored beside the ones in memory: boosted trees, scorecard, linear with target means."""
    from lendframe.models.store import load_model, save_model
    train, held = halves(s, d)
    out = None
    for name, make in {"boosted": lambda: learners.boosted_trees(MODEL_INPUTS, n_trees=10, learning_rate=0.2),
                       "scorecard": lambda: learners.WoeScorecard(MODEL_INPUTS, min_iv=0.0),
                       "logistic": lambda: learners.logistic_regression(MODEL_INPUTS)}.items():
        fitted, path = make().fit(train, "y"), fresh_folder(s, "model")
        save_model(s, fitted, path, {"description": name})
        pair = fitted.transform(held).withColumnRenamed("p", "before").transform(load_model(s, path).transform)
        part = pair.select(F.lit(name).alias("model"), "id", "y", F.col("before").eqNullSafe(F.col("p")).cast("int").alias("same"),
                           F.col("p").between(0, 1).cast("int").alias("inside"))
        out = part if out is None else out.unionByName(part)
    return out


add("md_20_saved_model", "s:model i:id,y,same,inside", _saved,
    """SELECT model, id, y, 1 AS same, 1 AS inside FROM folded, (SELECT unnest(['boosted', 'scorecard', 'logistic']) AS model)
       WHERE fold = 1""", APP, FOLDED)
