"""MLlib learners with the settings the workload uses, as zero-argument builders for the CV runner.

A builder returns an object with ``fit(df, label, weight=None)`` whose result adds a column ``p``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.hashing import seeded_hash
from lendframe.functions.stable import sigmoid
from lendframe.operators import encoders, woe


@dataclass
class Inputs:
    """Column groups of a model table."""
    numeric: list[str]
    small: list[str] = field(default_factory=list)
    large: list[str] = field(default_factory=list)


def inputs_of(inputs: dict, crossed: bool = False) -> dict[str, Column]:
    """Name -> expression of every model input, from what the preprocessor learned (plain numbers and names)."""
    kind = inputs["kind"]
    if kind == "linear":
        return encoders.linear_columns(inputs["fit"], crossed)
    if kind == "woe":
        return woe.woe_columns(inputs["rules"])
    if kind == "tree":
        fill = inputs["fill"]
        out = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c][0])) for c in fill}
        out.update({f"{c}_missing": F.isnull(c).cast("double") for c in fill if fill[c][1]})
        return out | {c: F.coalesce(F.col(f"{c}_number"), F.when(F.isnull(c), -2.0).otherwise(-1.0)) for c in inputs["levels"]}
    return {}


def with_levels(df: DataFrame, inputs: dict, crossed: bool = False) -> DataFrame:
    """The rows with what `inputs_of` needs from stored level tables."""
    if inputs["kind"] == "linear" and not crossed:
        return encoders.with_means(df, inputs["fit"])
    return encoders.looked_up(df, inputs["levels"], "_number") if inputs["kind"] == "tree" else df


def probability_of(output: dict) -> Column:
    """The column ``p`` of a fitted model."""
    from lendframe.models import moments
    kind = output["kind"]
    if kind == "constant":
        return F.lit(output["p"])
    if kind == "margin":
        margin = vector_to_array(F.col("rawPrediction"))[1]
        return margin if output["slope"] is None else sigmoid(margin * output["slope"] + output["intercept"])
    if kind == "stumps":
        votes, total = F.lit(0.0), sum(s[-1] for s in output["stumps"]) or 1.0
        for feature, cut, left, right, alpha in output["stumps"]:
            side = F.lit(float(left)) if feature is None else F.when(
                F.col(f"_x{feature}") <= cut, float(left)).otherwise(float(right))
            votes = votes + alpha * (2 * side - 1)
        return sigmoid(votes / total)
    if kind == "bayes":
        return sigmoid(moments.naive_bayes_logit(output["model"]))
    return second_class()


@dataclass
class Scored:
    """A fitted model: preprocessing as projections, then an MLlib model if there is one, then ``p``.

    inputs and output hold numbers, names and lists only, so `models.store` can write them as JSON.
    """
    inputs: dict
    model: PipelineModel | None
    output: dict
    info: dict = field(default_factory=dict)
    crossed: bool = False

    @property
    def columns(self) -> dict[str, Column]:
        return inputs_of(self.inputs, self.crossed)

    def ready(self, df: DataFrame) -> DataFrame:
        """The rows with what ``columns`` are made of."""
        return with_levels(df, self.inputs, self.crossed)

    def transform(self, df: DataFrame) -> DataFrame:
        from lendframe.models import moments
        names = {f"_x{i}": e for i, e in enumerate(self.columns.values())}
        work = self.ready(df)
        work = work.withColumns(names) if names else work
        if self.output.get("axes"):
            work = work.withColumns(moments.pca_columns(self.output["axes"]))
        if self.model is not None:
            work = self.model.transform(work)
        return work.withColumn("p", probability_of(self.output)).select(*[c for c in df.columns if c != "p"], "p")


def _assemble(columns: dict[str, Column], df: DataFrame, keep: Sequence[str]):
    names = [f"_x{i}" for i in range(len(columns))]
    rows = df.select(*keep, *[e.alias(n) for n, e in zip(names, columns.values())])
    return rows, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")


def _fit(inputs: dict, estimator, df, label, weight, output: dict, info=None, validation=None) -> Scored:
    """Rows with cross-fitted encodings (see `Learner.training`) take these, rows to score the means of all rows."""
    keep = [label, *([weight] if weight else []), *([validation] if validation else [])]
    columns = inputs_of(inputs, crossed=True)
    rows, assembler = _assemble(columns, with_levels(df.where(F.col(label).isNotNull()), inputs, crossed=True), keep)
    estimator.setLabelCol(label)
    if weight:
        estimator.setWeightCol(weight)
    model = Pipeline(stages=[assembler, estimator]).fit(rows)
    return Scored(inputs, model, output, {"names": list(columns), **(info or {})})


PROBABILITY = "probability"
SECOND_CLASS = {"kind": "class"}


def second_class() -> Column:
    return vector_to_array(F.col(PROBABILITY))[1]


class Learner:
    """Linear preprocessing or tree preprocessing in front of an MLlib estimator."""

    def __init__(self, inputs: Inputs, make: Callable, kind: str = "linear", key: str = "id", validation: str | None = None):
        self.inputs, self.make, self.kind, self.key, self.validation = inputs, make, kind, key, validation

    def training(self, df: DataFrame, label: str) -> tuple[dict, DataFrame]:
        """What the preprocessor learned, and the rows to fit on.

        For linear inputs these rows hold their target encodings: a level's mean over the other folds.
        """
        learned = self.learned(df, label)
        if self.kind != "linear" or not self.inputs.large:
            return learned, df
        return learned, encoders.cross_fitted(df, self.key, label, self.inputs.large)

    def learned(self, df: DataFrame, label: str) -> dict:
        i = self.inputs
        if self.kind == "linear":
            return {"kind": "linear", "fit": encoders.fit_linear(df, self.key, label, i.numeric, i.small, i.large)}
        texts = [*i.small, *i.large]
        return {"kind": "tree", "fill": encoders.fit_imputer(df, i.numeric),
                "levels": {c: encoders.path_of(encoders.level_numbers(df, c), "numbers") for c in texts}}

    def fit(self, df: DataFrame, label: str, weight: str | None = None) -> Scored:
        rows = df.where(F.col(label).isNotNull())
        if self.validation is None:
            learned, train = self.training(rows, label)
        else:  # rows that only tell when to stop teach the preprocessor nothing
            learned, train = self.learned(rows.where(~F.col(self.validation)), label), rows
        return _fit(learned, self.make(rows), train, label, weight, SECOND_CLASS, validation=self.validation)


def dummy() -> Learner:
    class Prior:
        def fit(self, df, label, weight=None):
            share = df.agg(F.avg(label)).first()[0]
            return Scored({"kind": "none"}, None, {"kind": "constant", "p": float(share)})
    return Prior()


def logistic_regression(inputs: Inputs, C: float = 0.1) -> Learner:
    """C is the inverse penalty per row sum, MLlib's regParam is per row mean."""
    return Learner(inputs, lambda rows: LogisticRegression(
        regParam=1.0 / (C * max(rows.count(), 1)), standardization=False, maxIter=100))


def decision_tree(inputs: Inputs, max_depth: int = 6, min_leaf: int = 200, seed: int = 42) -> Learner:
    return Learner(inputs, lambda rows: DecisionTreeClassifier(
        maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed), "tree")


def boosted_trees(inputs: Inputs, n_trees: int = 500, learning_rate: float = 0.05, depth: int = 5,
                  subsample: float = 0.8, colsample: float = 0.5, min_leaf: int = 20, seed: int = 42,
                  validation: str | None = None) -> Learner:
    def make(rows):
        gbt = GBTClassifier(maxIter=n_trees, stepSize=learning_rate, maxDepth=depth, subsamplingRate=subsample,
                            featureSubsetStrategy=str(colsample), minInstancesPerNode=min_leaf, seed=seed,
                            checkpointInterval=10)
        return gbt.setValidationIndicatorCol(validation) if validation else gbt
    return Learner(inputs, make, "tree", validation=validation)


def random_forest(inputs: Inputs, n_trees: int = 150, min_leaf: int = 50, seed: int = 42) -> Learner:
    return Learner(inputs, lambda rows: RandomForestClassifier(
        numTrees=n_trees, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", subsamplingRate=0.3,
        maxDepth=12, seed=seed), "tree")


class LayeredNet(Learner):
    """Multilayer perceptron on the linear preprocessor's columns."""

    def __init__(self, inputs: Inputs, hidden: Sequence[int] = (32,), max_iter: int = 100, seed: int = 42):
        super().__init__(inputs, None)
        self.hidden, self.max_iter, self.seed = hidden, max_iter, seed

    def fit(self, df, label, weight=None):
        rows = df.where(F.col(label).isNotNull())
        learned, train = self.training(rows, label)
        net = MultilayerPerceptronClassifier(layers=[len(inputs_of(learned)), *self.hidden, 2], maxIter=self.max_iter,
                                             seed=self.seed)
        return _fit(learned, net, train, label, None, SECOND_CLASS)


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Sigmoid calibration (slope, intercept) on soft targets.

    A positive counts (n1+1)/(n1+2) as 1, a negative 1/(n0+2); each row enters once per class with
    those weights, so the fit is an ordinary weighted logistic regression.
    """
    n = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    counts = {int(r[label]): r["n"] for r in n}
    hi = (counts.get(1, 0) + 1) / (counts.get(1, 0) + 2)
    lo = 1 / (counts.get(0, 0) + 2)
    target = F.when(F.col(label) == 1, hi).otherwise(lo)
    both = F.array(F.struct(F.lit(1.0).alias("t"), target.alias("w")),
                   F.struct(F.lit(0.0).alias("t"), (1 - target).alias("w")))
    rows = df.select(F.col(score).cast("double").alias("s"), F.explode(both).alias("_b")).select("s", "_b.t", "_b.w")
    model = Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="features"),
                             LogisticRegression(labelCol="t", weightCol="w", maxIter=100)]).fit(rows).stages[1]
    return float(model.coefficients[0]), float(model.intercept)


class LinearMargin(Learner):
    """Linear SVM; its margin becomes a probability by sigmoid calibration on a held-out fifth."""

    def __init__(self, inputs: Inputs, C: float = 0.05, key: str = "id"):
        super().__init__(inputs, None, key=key)
        self.C = C

    def fit(self, df, label, weight=None):
        rows = df.where(F.col(label).isNotNull())
        learned, train = self.training(rows, label)
        held = encoders.hash_fold(self.key, 5, "margin") == 0
        n = max(rows.count(), 1)
        svm = LinearSVC(regParam=1.0 / (self.C * n), maxIter=100, standardization=False)
        raw = {"kind": "margin", "slope": None, "intercept": None}
        first = _fit(learned, svm, train.where(~held), label, weight, raw)
        judged = Scored(learned, first.model, raw, crossed=True).transform(train.where(held))
        slope, intercept = platt(judged, "p", label)
        return Scored(learned, first.model, {"kind": "margin", "slope": slope, "intercept": intercept}, first.info)


class NystroemMargin(LinearMargin):
    """RBF kernel SVM: distances to a few landmark rows become inputs of the linear SVM."""

    def __init__(self, inputs: Inputs, landmarks: int = 300, gamma: float | None = None, C: float = 0.05,
                 key: str = "id", seed: int = 42):
        super().__init__(inputs, C, key)
        self.landmarks, self.gamma, self.seed = landmarks, gamma, seed

    def fit(self, df, label, weight=None):
        rows = df.where(F.col(label).isNotNull())
        learned, train = self.training(rows, label)
        x = F.array(*inputs_of(learned, crossed=True).values())
        drawn = train.orderBy(seeded_hash(F.col(self.key), self.seed)).limit(self.landmarks).select(x.alias("x")).collect()
        marks = np.unique(np.array([r["x"] for r in drawn], dtype=float), axis=0)
        gamma = self.gamma or 1.0 / marks.shape[1]
        near = np.exp(-gamma * ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2))
        values, vectors = np.linalg.eigh(near)
        good = values > 1e-10 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        kernel = KernelMap(learned, marks, gamma, whiten)
        inner = LinearMargin(Inputs([f"_k{i}" for i in range(whiten.shape[1])]), self.C, self.key)
        made = kernel.transform(train, crossed=True).select(
            *dict.fromkeys([self.key, label, *([weight] if weight else [])]), *inner.inputs.numeric)
        return Chained(kernel, inner.fit(encoders.stored(made, "kernel-rows"), label, weight))  # read in several passes


@dataclass
class KernelMap:
    """Adds the kernel inputs _k0.. by Arrow batches: one matrix product per batch."""
    inputs: dict
    marks: np.ndarray
    gamma: float
    whiten: np.ndarray

    def transform(self, df: DataFrame, crossed: bool = False) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.marks, self.gamma, self.whiten))

        @F.pandas_udf("array<double>")
        def kernel(x: pd.Series) -> pd.Series:
            marks, gamma, whiten = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            a = np.stack(x.to_numpy()).astype(float)
            d = (a * a).sum(axis=1)[:, None] + (marks * marks).sum(axis=1)[None, :] - 2 * a @ marks.T
            return pd.Series(list(np.exp(-gamma * np.maximum(d, 0)) @ whiten))
        ready = with_levels(df, self.inputs, crossed)
        work = ready.withColumn("_kernel", kernel(F.array(*inputs_of(self.inputs, crossed).values())))
        return work.select(*df.columns, *[F.col("_kernel")[i].alias(f"_k{i}") for i in range(self.whiten.shape[1])])


@dataclass
class Chained:
    """Kernel inputs, then the fitted model on them."""
    first: KernelMap
    second: Scored

    def transform(self, df: DataFrame) -> DataFrame:
        return self.second.transform(self.first.transform(df)).select(*[c for c in df.columns if c != "p"], "p")


class WoeScorecard(Learner):
    """Weight-of-evidence inputs and a logistic regression."""

    def __init__(self, inputs: Inputs, C: float = 1.0, max_features: int = 30, min_iv: float = 0.02):
        super().__init__(inputs, None)
        self.C, self.max_features, self.min_iv = C, max_features, min_iv

    def fit(self, df, label, weight=None):
        rows = df.where(F.col(label).isNotNull())
        rules = woe.fit_woe(rows, label, self.inputs.numeric, [*self.inputs.small, *self.inputs.large],
                            self.min_iv, self.max_features)
        lr = LogisticRegression(regParam=1.0 / (self.C * max(rows.count(), 1)), standardization=False, maxIter=100)
        fitted = _fit({"kind": "woe", "rules": rules}, lr, rows, label, weight, SECOND_CLASS)
        linear = fitted.model.stages[1]
        fitted.info.update({"rules": rules, "coef": linear.coefficients.toArray().tolist(),
                            "intercept": linear.intercept})
        return fitted


class AdaBoost(Learner):
    """SAMME boosting of depth-1 trees. Row weights are cut off from their lineage every few rounds."""

    def __init__(self, inputs: Inputs, rounds: int = 100, learning_rate: float = 0.5, seed: int = 42,
                 cut_every: int = 5):
        super().__init__(inputs, None, "tree")
        self.rounds, self.rate, self.seed, self.cut_every = rounds, learning_rate, seed, cut_every

    def fit(self, df, label, weight=None):
        import math
        from lendframe.session import durable
        rows = df.where(F.col(label).isNotNull())
        learned = self.learned(rows, label)
        columns = inputs_of(learned)
        work, assembler = _assemble(columns, with_levels(rows, learned), [label])
        work = durable(assembler.transform(work).select("features", F.col(label).cast("double").alias("y"),
                                                        F.lit(1.0).alias("w")))
        stumps = []
        for r in range(self.rounds):
            tree = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=1, seed=self.seed,
                                          predictionCol="hit").fit(work)
            judged = tree.transform(work)
            wrong = (F.col("hit") != F.col("y")).cast("double")
            sums = judged.agg(F.sum("w").alias("w"), F.sum(wrong * F.col("w")).alias("e")).first()
            error = min(max(sums["e"] / sums["w"], 1e-10), 1 - 1e-10)
            if error >= 0.5:
                break
            alpha = self.rate * math.log((1 - error) / error)
            feature, cut, left, right = _stump(tree)
            stumps.append((feature, cut, left, right, alpha))
            work = judged.select("features", "y", (F.col("w") * F.exp(alpha * wrong) / sums["w"]
                                                   * F.lit(1.0)).alias("w"))
            if (r + 1) % self.cut_every == 0:
                work = durable(work)
        return Scored(learned, None, {"kind": "stumps", "stumps": stumps}, {"stumps": stumps, "names": list(columns)})


def _stump(tree) -> tuple:
    """(feature, threshold, class on the left, class on the right) of a fitted depth-1 tree."""
    root = tree._call_java("rootNode")
    if root.subtreeDepth() == 0:
        return None, 0.0, root.prediction(), root.prediction()
    split = root.split()
    return split.featureIndex(), split.threshold(), root.leftChild().prediction(), root.rightChild().prediction()


class NaiveBayes(Learner):
    """Gaussian naive Bayes on the linear preprocessor's columns, optionally on their first PCs."""

    def __init__(self, inputs: Inputs, components: int | None = None):
        super().__init__(inputs, None)
        self.components = components

    def fit(self, df, label, weight=None):
        from lendframe.models import moments
        rows = df.where(F.col(label).isNotNull())
        learned, train = self.training(rows, label)
        inside = inputs_of(learned, crossed=True)
        names = [f"_x{i}" for i in range(len(inside))]
        work = train.select(label, *[e.alias(n) for n, e in zip(names, inside.values())])
        axes = None
        if self.components:
            axes = moments.fit_pca(work, names, min(self.components, len(names)))
            second = moments.pca_columns(axes)
            work, names = work.select(label, *[e.alias(n) for n, e in second.items()]), list(second)
        model = moments.fit_naive_bayes(work, names, label)
        return Scored(learned, None, {"kind": "bayes", "model": model, "axes": axes}, {"model": model})


@dataclass
class Voted:
    """Training points in the space of the first principal components; a row is scored by the vote of its neighbours."""
    learned: dict
    axes: dict
    points: str  # folder of (id, v, y)
    k: int
    key: str

    def placed(self, df: DataFrame, label: str | None = None, crossed: bool = False) -> DataFrame:
        """id, v (place on the components) and y; one matrix product a batch."""
        mean, axes = np.array(self.axes["mean"]), np.array(self.axes["axes"])

        def run(batches):
            import pyarrow as pa
            for batch in batches:
                x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(mean))
                v = (x - mean) @ axes.T
                ends = pa.array(np.arange(len(v) + 1) * axes.shape[0], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel())), batch.column("y")],
                                                 names=["id", "v", "y"])
        y = F.col(label).cast("double") if label else F.lit(None).cast("double")
        ready = with_levels(df, self.learned, crossed).select(
            F.col(self.key).cast("long").alias("id"), F.array(*inputs_of(self.learned, crossed).values()).alias("x"), y.alias("y"))
        return ready.mapInArrow(run, "id long, v array<double>, y double")

    def transform(self, df: DataFrame) -> DataFrame:
        from lendframe.operators.neighbours import vote
        points = encoders.df_at(df.sparkSession, self.points)
        asked = encoders.stored(self.placed(df).select("id", "v"), "asked")  # counted, then read
        found = vote(points.select("id", "v"), points.select("id", "y"), asked, self.k)
        found = found.withColumnRenamed("id", "_voted")
        return df.drop("p").join(found, df[self.key] == found["_voted"], "left").drop("_voted")


class NeighbourVote(Learner):
    """The columns a quick boosted model finds useful, the linear inputs made of them, their first principal
    components, and the share of positive labels among the nearest training rows."""

    def __init__(self, inputs: Inputs, select: int = 60, components: int = 20, k: int = 200, key: str = "id"):
        super().__init__(inputs, None, key=key)
        self.select, self.components, self.k = select, components, k

    def fit(self, df, label, weight=None):
        from lendframe.models import moments
        rows = df.where(F.col(label).isNotNull())
        if len(self.inputs.numeric) + len(self.inputs.small) + len(self.inputs.large) > self.select:
            self.inputs = narrowed(self.inputs, important_columns(rows, self.inputs, label, self.select))
        learned, train = self.training(rows, label)
        inside = inputs_of(learned, crossed=True)
        names = [f"_x{i}" for i in range(len(inside))]
        axes = moments.fit_pca(train.select(*[e.alias(n) for n, e in zip(names, inside.values())]), names, min(self.components, len(names)))
        fitted = Voted(learned, axes, "", self.k, self.key)
        fitted.points = encoders.path_of(fitted.placed(train, label, crossed=True), "points")
        return fitted


def important_columns(df: DataFrame, inputs: Inputs, label: str, k: int = 60, n_trees: int = 20,
                      seed: int = 42) -> list[str]:
    """The k columns a quick boosted model finds most useful, fitted on the training rows given."""
    fitted = boosted_trees(inputs, n_trees=n_trees, learning_rate=0.1, depth=5, seed=seed).fit(df, label)
    gains = fitted.model.stages[1].featureImportances.toArray()
    by_column: dict[str, float] = {}
    for name, g in zip(fitted.info["names"], gains):
        base = name[:-8] if name.endswith("_missing") else name
        by_column[base] = by_column.get(base, 0.0) + float(g)
    return sorted(by_column, key=lambda c: (-by_column[c], c))[:k]


def narrowed(inputs: Inputs, keep: Sequence[str]) -> Inputs:
    inside = set(keep)
    return Inputs([c for c in inputs.numeric if c in inside], [c for c in inputs.small if c in inside],
                  [c for c in inputs.large if c in inside])
