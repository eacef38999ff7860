"""Weight search and cross-validation for fused features."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wenloom.functions import vectors as V
from wenloom.operators import corpus, metrics, reduce
from wenloom.sources.tables import cut


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """With ``weight`` = rows / (classes * rows of the class); class counts are a few rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    weight = F.sum("n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n"))
    return df.join(F.broadcast(counts.select(label, weight.alias("weight"))), label)


def logistic(train: DataFrame, test: DataFrame, steps: int = 100) -> DataFrame:
    """``row_id, y, p`` of the test rows by balanced multinomial regression."""
    index = corpus.label_index(train, "y")
    back = {r["idx"]: r["label"] for r in index.collect()}
    rows = balanced(train).join(F.broadcast(index), F.col("y") == F.col("label")).select(reduce.ml_vector("x").alias("features"), F.col("idx").cast("double").alias("label"), "weight")
    fitted = LogisticRegression(family="multinomial", maxIter=steps, regParam=0.0, weightCol="weight", standardization=False).fit(rows)
    scored = fitted.transform(test.select("row_id", "y", reduce.ml_vector("x").alias("features")))
    names = F.create_map(*[z for i, c in back.items() for z in (F.lit(float(i)), F.lit(c))])
    return scored.select("row_id", "y", names[F.col("prediction")].alias("p"), vector_to_array("probability").alias("probability"))


def macro_f1(predicted: DataFrame) -> float:
    row = metrics.model_metrics(predicted.select("y", "p")).first()
    return row["macro_f1"] if row else 0.0


def grid_search(spark: SparkSession, train: dict[str, DataFrame], val: dict[str, DataFrame], labels: DataFrame, step: float = 0.1, workers: int = 4, model: str = "lr") -> DataFrame:
    """``w1, w2, w3, f1_macro`` of every weight triple; the frames have ``row_id, x``, the labels ``row_id, y``.

    Triples are independent jobs and share the cluster through threads.
    """
    if model != "lr":
        raise ValueError(f"unknown model: {model}")
    names = list(train)
    triples = [tuple(r) for r in reduce.weight_grid(spark, step).collect()]

    def joined(families: dict[str, DataFrame]) -> DataFrame:
        """One row per id with every family's vector and the label; written once for all triples."""
        out = labels.select("row_id", "y")
        for n in names:
            out = out.join(families[n].select("row_id", F.col("x").alias(f"x_{n}")), "row_id")
        return cut(out)

    a, b = joined(train), joined(val)

    def score(w: tuple[float, ...]) -> tuple[float, ...]:
        x = V.weighted_sum([F.col(f"x_{n}").cast("array<double>") for n in names], list(w))
        return (*w, macro_f1(logistic(*(f.select("row_id", "y", x.alias("x")) for f in (a, b)))))

    with ThreadPool(workers) as pool:
        rows = pool.map(score, triples)
    if not any(r[3] > 0 for r in rows):
        raise ValueError("no weights have a positive score")
    return spark.createDataFrame(rows, "w1 double, w2 double, w3 double, f1_macro double")


def ranked(results: DataFrame, top: int = 10) -> DataFrame:
    return results.orderBy(F.desc("f1_macro"), "w1", "w2", "w3").limit(top)


def cross_validate(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold, f1_macro`` of balanced regression on each fold."""
    folds = corpus.kfold(df, k, "row_id", seed)
    rows = [(i, macro_f1(logistic(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)))) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "fold int, f1_macro double")


def results_json(results: DataFrame, path: str) -> None:
    """Best weights, best score and all results as one JSON document."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("f1_macro", F.struct(F.col("w1").alias("tfidf"), F.col("w2").alias("word2vec"), F.col("w3").alias("bert")).alias("weights")))))
    rows = results.agg(ordered.alias("all_results")).select(F.col("all_results")[0]["weights"].alias("best_weights"), F.col("all_results")[0]["f1_macro"].alias("best_f1_macro"), "all_results")
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def fold_summary(scores: DataFrame, score: str = "f1_macro") -> DataFrame:
    """``mean, std``: over the folds, with the population deviation."""
    return scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
