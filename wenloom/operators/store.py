"""Saving and loading of fitted models: node tables as Parquet, numbers as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from wenloom.operators import ensemble, models, trees


def _about(model) -> dict:
    out = {"kind": type(model).__name__, "labels": list(model.labels)}
    if isinstance(model, models.BoostModel):
        out |= {"start": model.start, "rate": model.rate, "losses": model.losses, "rounds": len(model.rounds)}
    elif isinstance(model, models.BayesModel):
        out |= {"least": model.least, "log_prior": model.log_prior, "logs": model.logs}
    elif isinstance(model, models.LinearModel):
        out |= {"weights": model.weights.tolist(), "bias": model.bias.tolist(), "losses": model.losses}
    elif isinstance(model, models.SvmModel):
        out |= {"pairs": [list(p) for p in model.pairs], "weights": model.weights.tolist(), "bias": model.bias.tolist()}
    elif isinstance(model, models.NeighbourModel):
        out |= {"k": model.k}
    return out


def _grown(model) -> list[trees.Tree]:
    if isinstance(model, models.TreeModel):
        return [model.tree]
    if isinstance(model, models.ForestModel):
        return model.grown
    return [t for r in model.rounds for t in r] if isinstance(model, models.BoostModel) else []


def save(spark: SparkSession, model, path: str) -> None:
    about = json.dumps(_about(model), ensure_ascii=False)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    if grown := _grown(model):
        trees.save(spark, dict(enumerate(grown)), f"{path}/trees")
    if isinstance(model, models.NeighbourModel):
        model.rows.write.mode("overwrite").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str):
    a = json.loads(spark.read.text(f"{path}/about").first()[0])
    kind, labels = a["kind"], a["labels"]
    grown = [t for _, t in sorted(trees.load(spark, f"{path}/trees")[0].items())] if kind in ("TreeModel", "ForestModel") or a.get("rounds") else []
    if kind == "TreeModel":
        return models.TreeModel(labels, grown[0])
    if kind == "ForestModel":
        return models.ForestModel(labels, grown)
    if kind == "BoostModel":
        k = len(labels)
        return models.BoostModel(labels, a["start"], a["rate"], [grown[i : i + k] for i in range(0, len(grown), k)], a["losses"])
    if kind == "BayesModel":
        return models.BayesModel(labels, a["least"], a["log_prior"], a["logs"])
    if kind == "LinearModel":
        return models.LinearModel(labels, np.array(a["weights"]), np.array(a["bias"]), a["losses"])
    if kind == "SvmModel":
        return models.SvmModel(labels, [tuple(p) for p in a["pairs"]], np.array(a["weights"]), np.array(a["bias"]))
    if kind == "NeighbourModel":
        return models.NeighbourModel(labels, spark.read.parquet(f"{path}/rows"), a["k"])
    raise ValueError(f"unknown model: {kind}")


def save_stacked(spark: SparkSession, fitted: ensemble.Stacked, path: str) -> None:
    about = json.dumps({"order": fitted.order, "weights": fitted.weights, "labels": fitted.labels}, ensure_ascii=False)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    for name, m in (fitted.bases | {"meta": fitted.meta}).items():
        save(spark, m, f"{path}/{name}")


def load_stacked(spark: SparkSession, path: str) -> ensemble.Stacked:
    a = json.loads(spark.read.text(f"{path}/about").first()[0])
    return ensemble.Stacked(a["order"], {n: load(spark, f"{path}/{n}") for n in a["order"]}, a["weights"], load(spark, f"{path}/meta"), a["labels"])
