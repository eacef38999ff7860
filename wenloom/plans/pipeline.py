"""The classification pipeline: text to tokens, features, fused vectors, models, reports.

``Features`` is fitted on the training rows only. All scoring is by lazy
DataFrame plans, so one text and a table of any size take the same way.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wenloom.functions import text as X
from wenloom.operators import encoder, ensemble, metrics, models, reduce, search, store, terms
from wenloom.operators.segment import Segmenter
from wenloom.operators.wordvec import WordVectorModel, WordVectors
from wenloom.sources.tables import cut

TOKENIZERS = {"unicode_word": X.WORD, "ideographic": X.IDEOGRAPHIC}


def tokens(df: DataFrame, stopwords: list[str] | None = None, tokenizer: str | Segmenter = "ideographic", text: str = "text") -> DataFrame:
    """With ``tokens``: cleaned, cut by a pattern or a dictionary, without stop-words (None keeps all)."""
    clean = X.clean_text(F.col(text))
    if isinstance(tokenizer, Segmenter):
        cut_ = tokenizer.column(clean)
    elif tokenizer in TOKENIZERS:
        cut_ = X.tokenize(clean, TOKENIZERS[tokenizer])
    else:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return df.withColumn("tokens", X.without_stopwords(cut_, stopwords or []))


def stopwords(spark: SparkSession, path: str) -> list[str]:
    """The distinct words of a file, one per line; a missing file is an empty list."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("w"))
    return [r["w"] for r in lines.where("w <> ''").distinct().orderBy("w").collect()]


@dataclass
class Features:
    """TF-IDF and encoder states reduced to ``size`` dimensions and pooled word vectors, each standardised, then fused.

    ``weights`` names the families that are built: by default all three with a
    file of encoder weights, ``encoder_path``, and TF-IDF and word vectors without,
    since an encoder with random weights only adds noise; named in ``weights``
    it is built all the same. ``bert`` is its configuration, whose vocabulary is
    the training rows' characters unless ``characters`` are given.
    """

    size: int = 100
    weights: dict[str, float] | None = None
    max_features: int = 8000
    min_df: int = 2
    seed: int = 42
    tfidf: terms.TfidfModel | None = None
    pca: reduce.Pca | None = None
    words: WordVectorModel | None = None
    scalers: dict[str, reduce.Scaler] = field(default_factory=dict)
    bert: encoder.EncoderConfig = field(default_factory=lambda: encoder.EncoderConfig(vocab=0, width=128, layers=2, heads=2, inner=512))
    encoder_path: str | None = None
    characters: dict[str, int] = field(default_factory=dict)
    bert_weights: dict | None = None
    bert_pca: reduce.Pca | None = None

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = {"tfidf": 0.2, "word2vec": 0.3, "bert": 0.5} if self.encoder_path else {"tfidf": 0.4, "word2vec": 0.6}

    def _texts(self, df: DataFrame) -> DataFrame:
        return df.select("row_id", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), " ").alias("text"))

    def _families(self, df: DataFrame) -> dict[str, DataFrame]:
        rows = reduce.sparse_rows(self.tfidf.transform(self._texts(df)))
        at_zero = F.array(*[F.lit(float(v)) for v in -(self.pca.components @ self.pca.mean)])
        reduced = df.select("row_id").join(reduce.project_sparse(rows, self.pca), "row_id", "left").select("row_id", F.coalesce("x", at_zero).alias("x"))
        pooled = self.words.transform(df.select("row_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")), self.tfidf.vocab.select("term", "idf"))
        own = {"tfidf": reduced, "word2vec": pooled}
        if "bert" in self.weights:
            own["bert"] = self.bert_pca.transform(self._states(df))
        return {n: own[n] for n in self.weights}

    def _states(self, df: DataFrame) -> DataFrame:
        return encoder.encoded(self._texts(df), self.bert_weights, self.bert, self.characters)

    def _fit_encoder(self, df: DataFrame) -> None:
        self.characters = self.characters or encoder.corpus_vocabulary(self._texts(df))
        known = max(self.characters.values(), default=0) + 1
        self.bert = replace(self.bert, vocab=max(self.bert.vocab, known, 200))
        self.bert_weights = encoder.load_weights(self.bert, self.encoder_path, self.seed)
        if self.encoder_path and np.array_equal(self.bert_weights["word"], encoder.random_weights(self.bert, self.seed)["word"]):
            raise ValueError("the encoder's file is missing or doesn't fit its configuration")
        states = cut(self._states(df))
        fitted = reduce.fit_pca(states, len(self.pca.components))
        if len(fitted.components) < len(self.pca.components):
            raise ValueError("the encoder is too narrow, or the rows too few, for the other families' size")
        self.bert_pca = fitted

    def fit(self, df: DataFrame) -> Features:
        """``df``: ``row_id, tokens`` of the training rows."""
        docs = self._texts(df)
        self.tfidf = terms.Tfidf(self.max_features, self.min_df).fit(docs)
        self.tfidf = terms.TfidfModel(cut(self.tfidf.vocab), self.tfidf.low, self.tfidf.high, bounded=self.tfidf.bounded)
        rows = cut(reduce.sparse_rows(self.tfidf.transform(docs)))
        self.pca = reduce.fit_sparse_pca(rows, df.count(), self.tfidf.vocab.count(), self.size, seed=self.seed)
        self.words = WordVectors(size=len(self.pca.components), min_count=2, seed=self.seed).fit(df)
        self.words = WordVectorModel(cut(self.words.vectors), self.words.size)
        if "bert" in self.weights:
            self._fit_encoder(df)
        self.scalers = {n: reduce.fit_scaler(f) for n, f in self._families(df).items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``row_id, x``."""
        if self.tfidf is None:
            raise ValueError("fit the features first")
        return reduce.fuse({n: self.scalers[n].transform(f) for n, f in self._families(df).items()}, self.weights)

    def save(self, spark: SparkSession, path: str) -> None:
        self.tfidf.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.words.vectors.write.mode("overwrite").parquet(f"{path}/words")
        self.pca.save(spark, f"{path}/pca")
        for n, s in self.scalers.items():
            s.save(spark, f"{path}/scaler_{n}")
        about = {"size": self.size, "weights": self.weights, "words": self.words.size}
        if "bert" in self.weights:
            self.bert_pca.save(spark, f"{path}/bert_pca")
            rows = [(n, list(x.shape), x.tobytes()) for n, x in self.bert_weights.items()]
            spark.createDataFrame(rows, "name string, shape array<int>, value binary").write.mode("overwrite").parquet(f"{path}/bert_weights")
            about |= {"bert": asdict(self.bert), "characters": self.characters}
        about = json.dumps(about, ensure_ascii=False)
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Features:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = Features(about["size"], about["weights"])
        out.tfidf = terms.TfidfModel(spark.read.parquet(f"{path}/vocab"), 1, 2)
        out.words = WordVectorModel(spark.read.parquet(f"{path}/words"), about["words"])
        out.pca = reduce.Pca.load(spark, f"{path}/pca")
        if "bert" in out.weights:
            out.bert, out.characters = encoder.EncoderConfig(**about["bert"]), about["characters"]
            out.bert_pca = reduce.Pca.load(spark, f"{path}/bert_pca")
            rows = spark.read.parquet(f"{path}/bert_weights").toLocalIterator()
            out.bert_weights = {r["name"]: np.frombuffer(r["value"], np.float32).reshape(r["shape"]) for r in rows}
        out.scalers = {n: reduce.Scaler.load(spark, f"{path}/scaler_{n}") for n in out.weights}
        return out


@dataclass
class Classifier:
    """Features and an ensemble; ``predict`` takes ``row_id, text``."""

    features: Features
    fitted: ensemble.Stacked
    stopwords: list[str]
    tokenizer: str | Segmenter = "ideographic"

    def predict(self, df: DataFrame, method: str = "voting") -> DataFrame:
        vectors = self.features.transform(tokens(df, self.stopwords, self.tokenizer).select("row_id", "tokens"))
        return self.fitted.transform(vectors, method)

    def predict_text(self, spark: SparkSession, text: str, method: str = "voting") -> str | None:
        row = self.predict(spark.createDataFrame([(0, text)], "row_id long, text string"), method).first()
        return row["p"] if row else None

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/features")
        store.save_stacked(spark, self.fitted, f"{path}/ensemble")
        cutter = {"words": self.tokenizer.counts, "method": self.tokenizer.method} if isinstance(self.tokenizer, Segmenter) else self.tokenizer
        about = json.dumps({"stopwords": self.stopwords, "tokenizer": cutter}, ensure_ascii=False)
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Classifier:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        cutter = about["tokenizer"]
        if isinstance(cutter, dict):
            cutter = Segmenter(cutter["words"], method=cutter["method"])
        return Classifier(Features.load(spark, f"{path}/features"), store.load_stacked(spark, f"{path}/ensemble"), about["stopwords"], cutter)

    def evaluate(self, splits: dict[str, DataFrame], method: str = "voting") -> DataFrame:
        """``split`` and the metrics of labelled splits with ``row_id, text, y``."""
        out = None
        for name, df in splits.items():
            own = self.predict(df, method).join(df.select("row_id", "y"), "row_id").select(F.lit(name).alias("split"), "y", "p")
            out = own if out is None else out.unionByName(own)
        return metrics.model_metrics(out, ["split"])


def train(train_rows: DataFrame, val_rows: DataFrame, base: dict[str, dict], stop: list[str] | None = None, features: Features | None = None, folds: int = 5, meta: models.SoftmaxRegression | None = None, tokenizer: str | Segmenter = "ideographic") -> Classifier:
    """Fits features and ensemble on ``row_id, text, y``."""
    known = tokens(train_rows.where("y is not null"), stop, tokenizer)
    features = (features or Features()).fit(known.select("row_id", "tokens"))
    vectors = lambda df: cut(features.transform(df.select("row_id", "tokens")).join(df.select("row_id", "y"), "row_id"))
    fitted = ensemble.fit_stacked(vectors(known), vectors(tokens(val_rows.where("y is not null"), stop, tokenizer)), base, folds, meta)
    return Classifier(features, fitted, stop or [], tokenizer)


def compared(base: dict[str, dict], splits: dict[str, DataFrame], by: str = "train") -> DataFrame:
    """``model, split, seconds`` and the metrics of base models, each fitted on one of the splits (``row_id, x, y``).

    ``seconds``: of fitting, for the split fitted on, and of scoring.
    """
    rows, out = [], None
    for name, own in base.items():
        began = time.time()
        fitted = models.base_model(name, **own).fit(splits[by])
        took = time.time() - began
        for split, df in splits.items():
            began = time.time()
            scored = cut(fitted.transform(df.where("y is not null")).select(F.lit(name).alias("model"), F.lit(split).alias("split"), "y", "p"))
            rows.append((name, split, (took if split == by else 0.0) + time.time() - began))
            out = scored if out is None else out.unionByName(scored)
    times = splits[by].sparkSession.createDataFrame(rows, "model string, split string, seconds double")
    return metrics.model_metrics(out, ["model", "split"]).join(F.broadcast(times), ["model", "split"])


def optimise(spark: SparkSession, train_rows: dict[str, DataFrame], val_rows: dict[str, DataFrame], labels: DataFrame, step: float, path: str) -> DataFrame:
    """Standardise, search the weights, write the results as JSON and the best fusion as Parquet."""
    scalers = {n: reduce.fit_scaler(f) for n, f in train_rows.items()}
    a = {n: cut(scalers[n].transform(f)) for n, f in train_rows.items()}
    b = {n: cut(scalers[n].transform(f)) for n, f in val_rows.items()}
    found = cut(search.grid_search(spark, a, b, labels, step))
    search.results_json(found, f"{path}/weights")
    best = search.ranked(found, 1).first()
    weights = dict(zip(train_rows, (best["w1"], best["w2"], best["w3"])))
    for split, own in (("train", a), ("val", b)):
        reduce.fuse(own, weights).join(labels, "row_id").withColumn("weights", F.array(*[F.lit(w) for w in weights.values()])).write.mode("overwrite").parquet(f"{path}/fused/split={split}")
    for n, s in scalers.items():
        s.save(spark, f"{path}/scaler_{n}")
    return found
