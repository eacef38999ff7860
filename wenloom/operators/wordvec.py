"""Word vectors: training by skip-gram, and pooling to rows.

Training is the built-in estimator's; pooling is ours, since the built-in
transform divides by all tokens, known or not. Rows without a known word get
the zero vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wenloom.operators.terms import pooled, term_counts


@dataclass(frozen=True)
class WordVectorModel:
    vectors: DataFrame  # word, vector
    size: int

    def transform(self, df: DataFrame, weights: DataFrame | None, tokens: str = "tokens", row_id: str = "row_id") -> DataFrame:
        """``row_id, x``: idf-weighted means; words that ``weights`` (term, idf) lacks weigh one."""
        if weights is None:
            weights = df.sparkSession.createDataFrame([], "term string, idf double")
        flat = self.vectors.select("word", F.posexplode("vector").alias("idx", "x"))
        cells = pooled(term_counts(df, tokens, row_id).withColumnRenamed("term", "word"), flat, weights, row_id)
        rows = cells.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("x"))
        return df.select(row_id).join(rows, row_id, "left").select(row_id, F.coalesce("x", F.array_repeat(F.lit(0.0), self.size)).alias("x"))


#: Rows whose words one task trains on at a time.
TASK_ROWS = 100_000


@dataclass(frozen=True)
class WordVectors:
    """Skip-gram vectors. ``partitions``: None takes one per TASK_ROWS rows, whose weights are averaged after each epoch."""

    size: int = 100
    window: int = 5
    min_count: int = 5
    epochs: int = 10
    seed: int = 42
    rate: float = 0.025
    partitions: int | None = None

    def fit(self, df: DataFrame, tokens: str = "tokens") -> WordVectorModel:
        rows = df.where(F.col(tokens).isNotNull()).select(F.filter(tokens, lambda t: t.isNotNull()).alias("tokens"))
        partitions = self.partitions or max(1, -(-rows.count() // TASK_ROWS))
        trained = Word2Vec(vectorSize=self.size, windowSize=self.window, minCount=self.min_count, maxIter=self.epochs, seed=self.seed, stepSize=self.rate, numPartitions=partitions, inputCol="tokens", outputCol="out").fit(rows)
        from pyspark.ml.functions import vector_to_array

        return WordVectorModel(trained.getVectors().select("word", vector_to_array("vector").alias("vector")), self.size)
