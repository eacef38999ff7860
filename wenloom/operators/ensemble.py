"""Soft voting by F1 weights, out-of-fold features and stacking.

Predictions are long: ``row_id, model, label, q``. Weights and folds are small
tables. Every fold and every refit makes a fresh model. Defined cases: models
whose F1 sum is zero share equal weights; a row that a model can't score has
no votes of it; rows without any votes are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wenloom.operators import corpus, metrics
from wenloom.operators.models import Model, SoftmaxRegression, base_model
from wenloom.sources.tables import cut


def vote_weights(scores: DataFrame) -> DataFrame:
    """``model, weight`` from ``model, f1``: one row per model."""
    total = F.sum("f1").over(Window.partitionBy())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return scores.select("model", F.when(total > 0, F.col("f1") / total).otherwise(F.lit(1.0) / n).alias("weight"))


def soft_vote(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """``row_id, label, q``: the weighted sum of the models' probabilities."""
    return votes.join(F.broadcast(weights), "model").groupBy("row_id", "label").agg(F.sum(F.col("weight") * F.col("q")).alias("q"))


def decided(votes: DataFrame) -> DataFrame:
    """``row_id, p``: the first label with the largest sum."""
    first = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc(F.round("q", 12)), "label"))
    return votes.withColumn("r", first).where("r = 1").select("row_id", F.col("label").alias("p"))


def hard_vote(votes: DataFrame) -> DataFrame:
    """``row_id, p`` from ``row_id, model, p``: the label most models give, the smaller on ties."""
    n = votes.groupBy("row_id", "p").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("n"), "p"))
    return n.withColumn("r", first).where("r = 1").select("row_id", "p")


def long_votes(name: str, model: Model, df: DataFrame) -> DataFrame:
    scored = model.transform(df).where("probability is not null").select("row_id", F.posexplode("probability").alias("label_idx", "q"))
    return scored.select("row_id", F.lit(name).alias("model"), "label_idx", "q")


def laid_out(votes: DataFrame, order: list[str]) -> DataFrame:
    """``row_id, x``: one block of probabilities per model, in the models' order."""
    at = F.create_map(*[y for i, m in enumerate(order) for y in (F.lit(m), F.lit(i))])
    cells = F.array_sort(F.collect_list(F.struct(at[F.col("model")].alias("m"), "label_idx", "q")))
    return votes.groupBy("row_id").agg(F.transform(cells, lambda c: c["q"]).alias("x"))


@dataclass
class Stacked:
    order: list[str]
    bases: dict[str, Model]
    weights: dict[str, float]
    meta: Model
    labels: list = field(default_factory=list)

    def features(self, df: DataFrame) -> DataFrame:
        votes = None
        for m in self.order:
            own = long_votes(m, self.bases[m], df)
            votes = own if votes is None else votes.unionByName(own)
        return laid_out(votes, self.order)

    def transform(self, df: DataFrame, method: str = "stacking") -> DataFrame:
        """``row_id, probability, p`` by ``stacking`` or ``voting``."""
        if method == "stacking":
            return self.meta.transform(self.features(df)).select("row_id", "probability", "p")
        if method != "voting":
            raise ValueError(f"unknown method: {method}")
        spark = df.sparkSession
        votes = None
        for m in self.order:
            own = long_votes(m, self.bases[m], df)
            votes = own if votes is None else votes.unionByName(own)
        table = spark.createDataFrame(sorted(self.weights.items()), "model string, weight double")
        summed = soft_vote(votes.withColumnRenamed("label_idx", "label"), table)
        cells = F.transform(F.array_sort(F.collect_list(F.struct("label", "q"))), lambda c: c["q"])
        rows = summed.groupBy("row_id").agg(cells.alias("probability"))
        return rows.withColumn("p", F.get(F.array(*[F.lit(c) for c in self.labels]), (F.array_position("probability", F.array_max("probability")) - 1).cast("int")))


def out_of_fold(df: DataFrame, names: dict[str, dict], k: int = 5, seed: int = 42) -> DataFrame:
    """``row_id, model, label_idx, q``: every row scored by the models that didn't see it."""
    folds = cut(corpus.kfold(df, k, "row_id", seed))
    votes = None
    for i in range(k):
        rest, own = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        for name, params in names.items():
            scored = long_votes(name, base_model(name, **params).fit(rest), own.select("row_id", "x"))
            votes = scored if votes is None else votes.unionByName(scored)
    return votes


def fit_stacked(train: DataFrame, val: DataFrame, names: dict[str, dict], k: int = 5, meta: SoftmaxRegression | None = None) -> Stacked:
    """Bases fitted once on all training rows; weights by macro F1 on ``val``; a meta-model on out-of-fold features.

    Every fold must hold each class, so that all models score the same labels.
    """
    bases = {n: base_model(n, **p).fit(train) for n, p in names.items()}
    labels = next(iter(bases.values())).labels
    f1 = {}
    for n, m in bases.items():
        row = metrics.model_metrics(m.transform(val).select("y", "p")).first()
        f1[n] = row["macro_f1"] if row else 0.0
    total = sum(f1.values())
    weights = {n: v / total if total else 1 / len(f1) for n, v in f1.items()}
    order = list(names)
    features = laid_out(cut(out_of_fold(train, names, k)), order).join(train.select("row_id", "y"), "row_id")
    fitted = (meta or SoftmaxRegression(rate=0.1, penalty=0.01)).fit(features)
    return Stacked(order, bases, weights, fitted, labels)
