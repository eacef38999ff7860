"""Term statistics: document frequency, vocabulary, idf, TF-IDF rows in long form.

Input is ``row_id`` and a token array; rows with a null or empty array have no
terms but count as documents. The long form ``row_id, term, value`` is never
densified. Ties of the vocabulary's limit go to the smaller term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wenloom.functions.text import word_ngrams
from wenloom.sources.tables import cut

#: Terms of a vocabulary up to which it is broadcast.
MOST_SENT = 100_000


def term_counts(df: DataFrame, tokens: str = "tokens", row_id: str = "row_id") -> DataFrame:
    """``row_id, term, tf``."""
    return df.select(row_id, F.explode(tokens).alias("term")).where("term is not null").groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_df(counts: DataFrame) -> DataFrame:
    """``term, df, total``."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary(stats: DataFrame, n_docs: DataFrame, max_features: int | None = 8000, min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    """``term, idx, df, total``: the most frequent terms, numbered alphabetically.

    ``n_docs``: one row with ``n``. The limit bounds the table, so its two
    sorts never see more than ``max_features`` rows in one task; without one the
    terms are numbered in ranges, whose sizes add up to each range's first number.
    """
    kept = stats.join(F.broadcast(n_docs)).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n"))).drop("n")
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
        return kept.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)
    placed = cut(kept.repartitionByRange("term").withColumn("__part", F.spark_partition_id()))
    # A row per range, as many as there are partitions.
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("term")) - 1
    return placed.join(F.broadcast(before), "__part").withColumn("idx", (rank + F.col("__before")).cast("int")).drop("__part", "__before")


def idf(vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """With ``idf`` = ln((1 + n) / (1 + df)) + 1."""
    return vocab.join(F.broadcast(n_docs)).withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).drop("n")


def weighted(counts: DataFrame, vocab: DataFrame, row_id: str = "row_id", tf: str = "count", norm: str | None = "l2", bounded: bool = False) -> DataFrame:
    """``row_id, term, idx, value``: tf times idf; ``tf='relative'`` divides by the row's tokens.

    Relative frequencies count all of a row's tokens, in the vocabulary or not. A
    ``bounded`` vocabulary (at most MOST_SENT terms) is broadcast, so that a row's
    cells stay where they are.
    """
    own = counts
    if tf == "relative":
        own = own.withColumn("tf", F.col("tf") / F.sum("tf").over(Window.partitionBy(row_id)))
    known = vocab.select("term", "idx", "idf")
    rows = own.join(F.broadcast(known) if bounded else known, "term").withColumn("value", F.col("tf") * F.col("idf"))
    if norm == "l2":
        rows = rows.withColumn("value", F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(row_id))))
    return rows.select(row_id, "term", "idx", "value")


@dataclass(frozen=True)
class TfidfModel:
    vocab: DataFrame
    low: int
    high: int
    tf: str = "count"
    norm: str | None = "l2"
    bounded: bool = False

    def transform(self, df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
        return weighted(term_counts(gram_rows(df, text, row_id, self.low, self.high), "grams", row_id), self.vocab, row_id, self.tf, self.norm, self.bounded)


def gram_rows(df: DataFrame, text: str, row_id: str, low: int, high: int) -> DataFrame:
    return df.select(row_id, word_ngrams(F.coalesce(F.col(text), F.lit("")), low, high).alias("grams"))


@dataclass(frozen=True)
class Tfidf:
    """Estimator: vocabulary and idf from the rows it is fitted on."""

    max_features: int | None = 8000
    min_df: int = 2
    max_df: float = 0.8
    low: int = 1
    high: int = 2
    tf: str = "count"
    norm: str | None = "l2"

    def _fitted(self, counts: DataFrame, df: DataFrame) -> TfidfModel:
        n = df.agg(F.count(F.lit(1)).alias("n"))
        return TfidfModel(idf(vocabulary(term_df(counts), n, self.max_features, self.min_df, self.max_df), n), self.low, self.high, self.tf, self.norm, self.max_features is not None and self.max_features <= MOST_SENT)

    def fit(self, df: DataFrame, text: str = "text", row_id: str = "row_id") -> TfidfModel:
        return self._fitted(term_counts(gram_rows(df, text, row_id, self.low, self.high), "grams", row_id), df)

    def fit_transform(self, df: DataFrame, text: str = "text", row_id: str = "row_id") -> tuple[TfidfModel, DataFrame]:
        """The model and the weighted rows; the texts are cut and counted once."""
        counts = cut(term_counts(gram_rows(df, text, row_id, self.low, self.high), "grams", row_id))
        model = self._fitted(counts, df)
        return model, weighted(counts, model.vocab, row_id, self.tf, self.norm, model.bounded)


def pooled(tokens: DataFrame, vectors: DataFrame, weights: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, idx, value``: weighted mean of the known words' vectors, with multiplicity.

    ``tokens``: ``row_id, word, tf``; ``vectors``: ``word, idx, x``; ``weights``:
    ``term, idf`` (words it lacks weigh one). Rows without a known word are left
    out: their vector is zero.
    """
    own = tokens.join(weights.select(F.col("term").alias("word"), "idf"), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    rows = own.join(vectors, "word")
    return rows.groupBy(row_id, "idx").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))
