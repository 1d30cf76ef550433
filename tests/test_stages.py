"""Encoders as pipeline stages: in a Pipeline, in a CrossValidator, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from lendframe.models.stages import Clipper, MedianFiller, TargetEncoder, WoeEncoder
from lendframe.operators import encoders
from lendframe.session import fresh_folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = []
    for i in range(900):
        a = float(rng.normal()) if i % 8 else None
        y = int(rng.random() < (0.7 if (a or 0) + (i % 4 == 0) > 0.5 else 0.2))
        out.append((i, a, float(rng.normal() * (1000 if i == 5 else 1)), ["n", "s", None, "w"][i % 4], f"town {i % 30}", y))
    return spark.createDataFrame(out, "id long, a double, b double, side string, town string, y int").cache()


def linear(rows):
    return Pipeline(stages=[
        Clipper(inputCols=["a", "b"], lower=0.01, upper=0.99), MedianFiller(inputCols=["a", "b"]),
        TargetEncoder(inputCols=["side", "town"], outputCols=["side_rate", "town_rate"], labelCol="y"),
        VectorAssembler(inputCols=["a", "b", "a_missing", "side_rate", "town_rate"], outputCol="features"),
        LogisticRegression(labelCol="y", maxIter=20)])


def scores(model, rows):
    return {r["id"]: tuple(r["probability"]) for r in model.transform(rows).select("id", "probability").collect()}


def test_a_pipeline_is_saved_and_loaded(spark, rows):
    model = linear(rows).fit(rows)
    new = rows.withColumn("town", F.when(F.col("id") % 3 == 0, "never seen").otherwise(F.col("town"))).withColumn("a", F.lit(None).cast("double"))
    path = fresh_folder(spark, "pipeline")
    model.write().save(path)
    loaded = PipelineModel.load(path)
    assert scores(loaded, new) == scores(model, new) and scores(loaded, rows) == scores(model, rows)
    unfitted = fresh_folder(spark, "stages")
    linear(rows).write().save(unfitted)
    again = scores(Pipeline.load(unfitted).fit(rows), new)
    assert all(again[i][1] == pytest.approx(p[1], abs=1e-6) for i, p in scores(model, new).items())


def test_fitted_values_are_those_of_the_encoders(rows):
    caps = encoders.fit_clipper(rows, ["b"], 0.01, 0.99)["b"]
    clipped = Clipper(inputCols=["b"], outputCols=["c"], lower=0.01, upper=0.99).fit(rows).transform(rows)
    assert clipped.where(~F.col("c").between(*caps)).count() == 0 and clipped.agg(F.max("c")).first()[0] == caps[1]
    filled = MedianFiller(inputCols=["a"]).fit(rows).transform(rows)
    assert filled.where("a IS NULL").count() == 0 and filled.agg(F.sum("a_missing")).first()[0] == rows.where("a IS NULL").count()


def test_a_row_that_is_fitted_on_does_not_see_its_own_label(rows):
    stage = TargetEncoder(inputCols=["town"], outputCols=["rate"], labelCol="y", smoothing=0.0)
    model = stage.fit(rows)
    inside = {r["id"]: r["rate"] for r in model.transform(rows).collect()}
    crossed = {r["id"]: r["encoded"] for r in encoders.target_encode(rows, "id", "town", "y", smoothing=0.0).collect()}
    assert inside == crossed
    outside = model.transform(rows.select("*"))  # another table: the means of all rows
    means = {r["town"]: r["m"] for r in rows.groupBy("town").agg(F.avg("y").alias("m")).collect()}
    assert all(r["rate"] == pytest.approx(means[r["town"]]) for r in outside.collect())


def test_cross_validation_over_stage_parameters(spark, rows):
    encoder, learner = WoeEncoder(inputCols=["a", "b", "side", "town"], labelCol="y"), LogisticRegression(labelCol="y", maxIter=20)
    grid = ParamGridBuilder().addGrid(encoder.minIv, [0.0, 0.3]).build()
    search = CrossValidator(estimator=Pipeline(stages=[encoder, learner]), estimatorParamMaps=grid, numFolds=2, seed=1,
                            evaluator=BinaryClassificationEvaluator(labelCol="y"))
    found = search.fit(rows)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.6
    path = fresh_folder(spark, "search")
    found.write().save(path)
    assert scores(CrossValidatorModel.load(path).bestModel, rows) == scores(found.bestModel, rows)
