"""Cross-validation, learning curves, ablation, search and calibration on top of any learner."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import quote

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.functions.hashing import hash_uniform
from lendframe.functions.stable import sigmoid
from lendframe.models.learners import platt
from lendframe.operators import bootstrap, metrics
from lendframe.operators.stats_tests import five_by_two
from lendframe.operators.joins import beside
from lendframe.session import durable, width


def out_of_fold(make: Callable, df: DataFrame, label: str, fold: str = "fold",
                folds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Every row scored by the model that did not see its fold. The loop is over folds, not rows."""
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)  # read by every fit; a lost block is recomputed
    out = None
    for k in folds:
        fitted = make().fit(rows.where(F.col(fold) != k), label)
        part = fitted.transform(rows.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- stored scores
SCORES = "id long, y int, p double, model string, fold int"


def _folder(path: str, model: str, fold: int) -> str:
    """Names are escaped as Spark escapes them in partition folders."""
    return f"{path}/model={quote(model, safe='')}/fold={fold}"


def finished(spark, path: str, model: str, fold: int) -> bool:
    """Is this model's fold stored whole? A write that was broken off leaves no mark."""
    from lendframe.sources.tables import exists
    return exists(spark, f"{_folder(path, model, fold)}/_SUCCESS")


def store_fold(scored: DataFrame, path: str, model: str, fold: int) -> None:
    scored.select(F.col("id").cast("long"), F.col("y").cast("int"), F.col("p").cast("double")).write.mode("overwrite").parquet(
        _folder(path, model, fold))


def stored_scores(spark, path: str, models: Sequence[str] | None = None) -> DataFrame:
    """id, y, p, model, fold of everything stored, or of some models; only their folders are read."""
    scores = spark.read.schema(SCORES).parquet(path)
    return scores if models is None else scores.where(F.col("model").isin(*models))


def run_or_load(spark, path: str, model: str, make: Callable, df: DataFrame, label: str, key: str = "id", fold: str = "fold",
                folds: Sequence[int] = (1, 2, 3, 4, 5)) -> int:
    """Stores out-of-fold scores of a learner, a folder a fold; folds that are stored are not fitted again.

    Returns how many fits it made, so a run that was broken off goes on where it stopped.
    """
    open_ = [k for k in folds if not finished(spark, path, model, k)]
    rows = df.withColumnsRenamed({key: "id", label: "y"}).persist(StorageLevel.MEMORY_AND_DISK) if open_ else None
    for k in open_:
        fitted = make().fit(rows.where(F.col(fold) != k), "y")
        store_fold(fitted.transform(rows.where(F.col(fold) == k)), path, model, k)
    if rows is not None:
        rows.unpersist()
    return len(open_)


def run_or_load_sets(spark, path: str, sets: dict[str, Sequence[str]], df: DataFrame, label: str, key: str = "id", fold: str = "fold",
                     folds: Sequence[int] = (1, 2, 3, 4, 5), C: float = 0.1) -> int:
    """The same for logistic regressions on several column sets, all of which are fitted in the same passes."""
    from lendframe.models import joint_cv
    open_ = {n: c for n, c in sets.items() if not all(finished(spark, path, n, k) for k in folds)}
    if not open_:
        return 0
    table = joint_cv.prepared(df, key, label, fold, list(dict.fromkeys(c for cols in open_.values() for c in cols)))
    scored = joint_cv.out_of_fold(table, joint_cv.fit_logistic(table, open_, C)).persist(StorageLevel.MEMORY_AND_DISK)
    for n in open_:
        for k in folds:
            store_fold(scored.where(F.col("fold") == k).withColumn("p", F.col(f"`{n}`")), path, n, k)
    scored.unpersist()
    return len(open_) * len(folds)


def side_by_side(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """id, y and one column of scores a model."""
    return scores.groupBy("id").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == n, F.col("p"))).alias(n) for n in models])


def model_results(scores: DataFrame, models: Sequence[str], n_boot: int = 200, seed=42) -> DataFrame:
    """One row a model, best first: metrics of all out-of-fold scores, interval of the AUC, mean and deviation over folds."""
    reps = bootstrap.metric_replicates(side_by_side(scores, models), "id", "y", models, "roc_auc", n_boot, seed)
    ends = reps.agg(*[F.percentile(F.when(F.col("rep") > 0, F.col(f"`{n}`")), [0.025, 0.975]).alias(n) for n in models])
    ends = ends.select(F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"`{n}`").alias("q")) for n in models])).alias("e"))
    ends = ends.select("e.model", F.col("e.q")[0].alias("roc_auc_low"), F.col("e.q")[1].alias("roc_auc_high"))
    by_fold = metrics.rank_metrics(scores, "y", "p", by=["model", "fold"]).groupBy("model").agg(
        F.avg("roc_auc").alias("fold_mean"), F.stddev_samp("roc_auc").alias("fold_std"))
    whole = metrics.evaluate(scores, "y", "p", by=["model"])
    return whole.join(by_fold, "model").join(ends, "model").orderBy(F.desc("roc_auc"))


def ablation_table(scores: DataFrame, steps: Sequence[str], n_boot: int = 300, seed=42) -> DataFrame:
    """step, roc_auc and its interval; gain over the step before with the interval of the paired replicates, and
    whether that interval leaves out 0."""
    reps = bootstrap.metric_replicates(side_by_side(scores, steps), "id", "y", steps, "roc_auc", n_boot, seed)
    drawn, parts = F.col("rep") > 0, []
    for before, step in zip([None, *steps], steps):
        value = F.col(f"`{step}`")
        gain = value - F.col(f"`{before}`") if before else F.lit(None).cast("double")
        first = F.col("rep") == 0
        parts.append(F.struct(
            F.lit(step).alias("step"), F.max(F.when(first, value)).alias("roc_auc"),
            F.percentile(F.when(drawn, value), [0.025, 0.975]).alias("q"), F.max(F.when(first, gain)).alias("gain"),
            F.percentile(F.when(drawn, gain), [0.025, 0.975]).alias("g")).alias(f"s{len(parts)}"))
    rows = reps.agg(*parts).select(F.explode(F.array(*[f"s{i}" for i in range(len(parts))])).alias("r")).select("r.*")
    low, high = F.col("g")[0], F.col("g")[1]
    return rows.select("step", "roc_auc", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "gain", low.alias("gain_low"),
                       high.alias("gain_high"), ((low > 0) | (high < 0)).cast("int").alias("significant"))


def fold_metrics(scored: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    return metrics.evaluate(scored, label, "p", by=[fold])


def cv_summary(scored: DataFrame, label: str, name: str, fold: str = "fold") -> DataFrame:
    """Mean and sample deviation of the fold metrics of one model."""
    per = fold_metrics(scored, label, fold)
    return per.agg(F.avg("roc_auc").alias("auc"), F.stddev_samp("roc_auc").alias("auc_std"),
                   F.avg("pr_auc").alias("pr_auc"), F.avg("ks").alias("ks"), F.avg("brier").alias("brier"),
                   F.sum("n").alias("n")).withColumn("model", F.lit(name))


def results_table(runs: dict[str, DataFrame], label: str) -> DataFrame:
    """One row per model, best first."""
    out = None
    for name, scored in runs.items():
        row = cv_summary(scored, label, name)
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("auc"))


def learning_curve(make: Callable, train: DataFrame, held: DataFrame, key: str, label: str,
                   shares: Sequence[float]) -> DataFrame:
    """AUC on the used training rows and on held-out rows; smaller samples are part of larger ones."""
    out = None
    train, held = train.persist(StorageLevel.MEMORY_AND_DISK), held.persist(StorageLevel.MEMORY_AND_DISK)
    for s in shares:
        part = train.where(hash_uniform(F.col(key), "curve") < s)
        fitted = make().fit(part, label)
        row = (metrics.rank_metrics(fitted.transform(part), label, "p").select(F.col("roc_auc").alias("train_auc"))
               .transform(beside, metrics.rank_metrics(fitted.transform(held), label, "p")
                                      .select(F.col("roc_auc").alias("held_auc")))
               .withColumn("share", F.lit(float(s))))
        out = row if out is None else out.unionByName(row)
    return out


def five_by_two_cv(make_a: Callable, make_b: Callable, halves: DataFrame, label: str, repeats: int = 5, at_once: int = 8) -> dict:
    """Paired test of two learners; ``halves`` has columns repeat (0..) and fold (0 or 1).

    The fits don't depend on each other and run several at once; all their scores are ranked in one pass.
    """
    parts = [halves.where(F.col("repeat") == i).persist(StorageLevel.MEMORY_AND_DISK) for i in range(repeats)]

    def one(run) -> DataFrame:
        i, held, side = run
        fitted = (make_a, make_b)[side]().fit(parts[i].where(F.col("fold") != held), label)
        scored = fitted.transform(parts[i].where(F.col("fold") == held))
        return scored.select(F.lit(i).alias("_repeat"), F.lit(held).alias("_held"), F.lit(side).alias("_side"), label, "p")

    with ThreadPoolExecutor(at_once) as pool:
        scored = list(pool.map(one, [(i, held, side) for i in range(repeats) for held in (0, 1) for side in (0, 1)]))
    by = ["_repeat", "_held", "_side"]
    # ranked in several jobs; a union keeps the partitions of all its parts
    stored = durable(reduce(DataFrame.unionByName, scored).coalesce(width(halves.sparkSession)))
    auc = {tuple(r[c] for c in by): r["roc_auc"] for r in metrics.rank_metrics(stored, label, "p", by=by).collect()}
    for part in parts:
        part.unpersist()
    return five_by_two([[auc[i, held, 0] - auc[i, held, 1] for held in (0, 1)] for i in range(repeats)])


# ---------------------------------------------------------------- search
# The tuned settings, (low, high, log scale, whole number), and the grid
SPACE = {
    "learning_rate": (0.02, 0.1, True, False),
    "num_leaves": (16, 128, True, True),
    "min_child_samples": (20, 500, True, True),
    "subsample": (0.5, 1.0, False, False),
    "colsample_bytree": (0.2, 0.8, False, False),
    "reg_lambda": (0.001, 30.0, True, False),
}
GRID = {"learning_rate": [0.02, 0.05, 0.1], "num_leaves": [16, 48, 128], "min_child_samples": [30, 150, 500]}


def grid_candidates(spark) -> DataFrame:
    """One row for every combination of the settings: a cross join of the lists of values."""
    out = None
    for setting, choices in GRID.items():
        values = spark.createDataFrame([(c,) for c in choices], [setting])
        out = values if out is None else out.crossJoin(values)
    return out


def random_candidates(trials: DataFrame, seed: int = 42) -> DataFrame:
    """Adds one column per setting to a table of trial numbers, drawn by hash."""
    out = {}
    for name, (low, high, log, whole) in SPACE.items():
        u = hash_uniform(F.concat_ws(":", F.col("trial"), F.lit(name)), seed)
        if log:
            import math
            value = F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
        else:
            value = F.lit(low) + u * F.lit(high - low)
        out[name] = F.floor(value + 0.5) if whole else value
    return trials.withColumns(out)


def stored_trials(spark, log: str) -> DataFrame:
    """trial, params, auc, trees of the trials scored so far: a folder a trial."""
    return spark.read.schema("number int, params string, auc double, trees int, trial int").json(log).select("trial", "params", "auc", "trees")


def run_search(spark, method: str, candidates: Sequence[dict], score: Callable[[dict], tuple[float, int]],
               path: str, at_once: int = 8) -> DataFrame:
    """Scores each candidate once; finished trials are kept in ``path`` and skipped on the next run.

    A stored trial with other settings than the candidate of its number is an error.
    """
    from lendframe.sources.tables import exists
    schema = "number int, params string, auc double, trees int"
    log = f"{path}/{method}"
    done = stored_trials(spark, log) if exists(spark, log) else spark.createDataFrame([], "trial int, params string, auc double, trees int")
    wanted = spark.createDataFrame([(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(candidates)],
                                   "trial int, wanted string")
    clash = done.join(wanted, on="trial", how="left").where("wanted IS NULL OR wanted <> params")
    if clash.limit(1).count():
        raise ValueError(f"{log} holds trials of other candidates")
    open_trials = wanted.join(done, on="trial", how="left_anti").orderBy("trial").collect()

    def one(trial) -> None:
        auc, trees = score(json.loads(trial["wanted"]))
        (spark.createDataFrame([(trial["trial"], trial["wanted"], float(auc), int(trees))], schema)
         .coalesce(1).write.mode("append").json(f"{log}/trial={trial['trial']}"))

    # several fits at once: each is a row of small jobs, and a trial is stored as soon as it is scored
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, open_trials))
    from pyspark.sql import Window
    order = Window.partitionBy("method").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return (stored_trials(spark, log).withColumn("method", F.lit(method))
            .withColumn("best_so_far", F.max("auc").over(order)))


def holdout_score(make: Callable[[dict], object], df: DataFrame, label: str, holdout: int = 1,
                  fold: str = "fold") -> Callable[[dict], tuple[float, int]]:
    """score(params): train on the other folds with early stopping on the hold-out fold.

    The preprocessor learns from the other folds only: a learner with a validation column leaves its rows out.
    """
    def score(params: dict) -> tuple[float, int]:
        flagged = df.withColumn("is_check", F.col(fold) == holdout)
        fitted = make(params).fit(flagged, label)
        auc = metrics.rank_metrics(fitted.transform(flagged.where("is_check")), label, "p").first()["roc_auc"]
        stage = fitted.model.stages[-1] if fitted.model else None
        return auc, getattr(stage, "getNumTrees", 0) or 0
    return score


# ---------------------------------------------------------------- calibration
def calibrate_sigmoid(df: DataFrame, score: str, label: str, fold: str,
                      folds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Cross-fitted sigmoid calibration: adds ``calibrated``."""
    table = []
    for k in folds:
        slope, intercept = platt(df.where(F.col(fold) != k), score, label)
        table.append((k, slope, intercept))
    out = F.lit(None).cast("double")
    for k, slope, intercept in table:
        out = F.when(F.col(fold) == k, sigmoid(F.col(score) * slope + intercept)).otherwise(out)
    return df.withColumn("calibrated", out)


def calibrate_isotonic(df: DataFrame, score: str, label: str, fold: str,
                       folds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Cross-fitted isotonic calibration: adds ``calibrated``."""
    out = None
    for k in folds:
        model = Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_f"), IsotonicRegression(
            featuresCol="_f", labelCol=label, predictionCol="calibrated")]).fit(
                df.where(F.col(fold) != k).select(score, F.col(label).cast("double").alias(label)))
        part = model.transform(df.where(F.col(fold) == k)).select(*df.columns, "calibrated")
        out = part if out is None else out.unionByName(part)
    return out
