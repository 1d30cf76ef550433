"""Fitted models on disk: what the preprocessor learned as JSON and tables, the MLlib pipeline if there is one.

Nothing is fitted again: a loaded model gives the scores of the saved one to the last digit, in any session.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from lendframe.models.learners import Chained, KernelMap, Scored, inputs_of
from lendframe.sources.tables import exists, read_json, write_json


def _tables(inputs: dict) -> list[tuple[dict, str]]:
    """(dictionary, key) of every stored level table among the inputs."""
    if inputs["kind"] == "linear":
        return [(m, "path") for m in inputs["fit"]["means"].values()]
    return [(inputs["levels"], c) for c in inputs.get("levels", {})]


def _copied(spark: SparkSession, inputs: dict, path: str) -> dict:
    """The inputs with their level tables copied into the model's folder and named by their place in it."""
    import copy
    inputs = copy.deepcopy(inputs)
    for i, (where, key) in enumerate(_tables(inputs)):
        spark.read.parquet(where[key]).write.mode("overwrite").parquet(f"{path}/levels-{i}")
        where[key] = f"levels-{i}"
    return inputs


def _placed(inputs: dict, path: str) -> dict:
    for where, key in _tables(inputs):
        where[key] = f"{path}/{where[key]}"
    return inputs


def _output(output: dict) -> dict:
    """JSON has text keys only; class numbers are whole numbers."""
    if output["kind"] == "bayes":
        output["model"]["classes"] = {int(k): v for k, v in output["model"]["classes"].items()}
    return output


def save_model(spark: SparkSession, fitted: Scored | Chained, path: str, info: dict | None = None) -> None:
    """Writes ``path``/about (JSON), ``path``/levels-* (tables) and ``path``/model (MLlib) of any fitted learner."""
    if isinstance(fitted, Chained):
        k = fitted.first
        kernel = {"inputs": _copied(spark, k.inputs, f"{path}/kernel"), "marks": k.marks.tolist(), "gamma": k.gamma, "whiten": k.whiten.tolist()}
        write_json(spark, kernel, f"{path}/kernel/about", sort=False)
        fitted = fitted.second
    if fitted.model is not None:
        fitted.model.write().overwrite().save(f"{path}/model")
    about = {"inputs": _copied(spark, fitted.inputs, path), "output": fitted.output, "features": list(fitted.columns), "info": info or {}}
    write_json(spark, about, f"{path}/about", sort=False)  # the order of columns counts


def load_model(spark: SparkSession, path: str) -> Scored | Chained:
    """Fails when the stored order of the features is not the one the preprocessor gives."""
    about = read_json(spark, f"{path}/about")
    inputs = _placed(about["inputs"], path)
    if list(inputs_of(inputs)) != about["features"]:
        raise ValueError("the stored feature order does not match the preprocessor")
    model = PipelineModel.load(f"{path}/model") if exists(spark, f"{path}/model") else None
    fitted = Scored(inputs, model, _output(about["output"]), {"names": about["features"], **about["info"]})
    if not exists(spark, f"{path}/kernel/about"):
        return fitted
    k = read_json(spark, f"{path}/kernel/about")
    return Chained(KernelMap(_placed(k["inputs"], f"{path}/kernel"), np.array(k["marks"]), k["gamma"], np.array(k["whiten"])), fitted)
