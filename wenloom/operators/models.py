"""Classifiers: every estimator's ``fit`` takes ``row_id, x, y`` and gives a model.

A model's ``transform`` adds ``probability`` (array in the order of
``labels``) and ``p`` (the first most probable label). Labels are sorted, so
index and label order agree. Fitting never changes an estimator: a second fit
starts afresh. Defined cases: rows with a null vector or label are left out of
fits; such rows are scored null; one class is always predicted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wenloom.functions import vectors as V
from wenloom.operators import corpus, growth, trees
from wenloom.operators.reduce import long_form
from wenloom.sources.tables import cut

TINY = 1e-10


def prepared(df: DataFrame) -> tuple[DataFrame, list]:
    """``row_id, x, y`` with y as index, and the sorted labels."""
    known = df.where("x is not null and y is not null").select("row_id", F.col("x").cast("array<double>").alias("x"), F.col("y").alias("label"))
    labels = [r[0] for r in known.select("label").distinct().orderBy("label").collect()]
    if not labels:
        raise ValueError("no labelled rows to fit on")
    index = F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, i)])
    return known.select("row_id", "x", index[F.col("label")].alias("y")), labels


def log_priors(rows: DataFrame, label: str = "y") -> DataFrame:
    """``label, f0``: the logarithm of each label's share, where boosting starts."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    share = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    return share.select(label, F.log(F.col("n") / F.col("total") + F.lit(TINY)).alias("f0"))


def class_pairs(labels: list) -> list[tuple[int, int]]:
    """Places of each two labels."""
    return [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]


@dataclass
class Model:
    labels: list

    def probability(self, x: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        p = df.withColumn("probability", F.when(F.col("x").isNotNull(), self.probability(F.col("x").cast("array<double>"))))
        return p.withColumn("p", F.get(F.array(*[F.lit(c) for c in self.labels]), V.argmax(F.col("probability"))))


# ---- trees ----------------------------------------------------------------------


@dataclass
class TreeModel(Model):
    tree: trees.Tree

    def probability(self, x: Column) -> Column:
        return V.one_hot(trees.predict_column([self.tree], x)[0], list(range(len(self.labels))))


def _grown(rows: DataFrame, criterion: trees.Criterion, bins: int | None, *own, features: dict[int, list[int]] | None = None) -> dict[int, trees.Tree]:
    """By histograms; without bins by exact thresholds over all distinct values."""
    return growth.fit(rows, criterion, bins, *own, features=features) if bins else trees.grow(rows, criterion, *own, features=features)


@dataclass(frozen=True)
class DecisionTree:
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    bins: int | None = growth.BINS

    def fit(self, df: DataFrame) -> TreeModel:
        rows, labels = prepared(df)
        rows = rows.select(F.lit(0).alias("tree"), "x", "y", F.lit(1.0).alias("w"))
        return TreeModel(labels, _grown(rows, trees.Gini(len(labels)), self.bins, self.max_depth, self.min_split, self.min_leaf)[0])


@dataclass(frozen=True)
class RegressionTree:
    max_depth: int | None = 3
    min_split: int = 2
    min_leaf: int = 1
    bins: int | None = growth.BINS

    def fit(self, df: DataFrame, target: str = "t") -> trees.Tree:
        rows = df.where(F.col(target).isNotNull()).select(F.lit(0).alias("tree"), F.col("x").cast("array<double>").alias("x"), F.col(target).cast("double").alias("t"), F.lit(1.0).alias("w"))
        return _grown(rows, trees.Variance(), self.bins, self.max_depth, self.min_split, self.min_leaf)[0]


@dataclass
class ForestModel(Model):
    grown: list[trees.Tree]

    def probability(self, x: Column) -> Column:
        """Share of the trees' votes."""
        votes = trees.predict_column(self.grown, x)
        share = lambda k: F.size(F.filter(votes, lambda v: v == k)) / F.lit(float(len(self.grown)))
        return F.array(*[share(k) for k in range(len(self.labels))])


@dataclass(frozen=True)
class RandomForest:
    n_trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    max_features: str | int | None = "sqrt"
    seed: int = 42
    block: int = 20
    bins: int | None = growth.BINS

    def subset(self, tree: int, size: int) -> list[int]:
        """One draw without replacement for the whole tree."""
        k = {"sqrt": int(size**0.5), "log2": int(np.log2(size)), None: size}.get(self.max_features, self.max_features)
        order = sorted(range(size), key=lambda j: hashlib.md5(f"{tree}-{j}-{self.seed}".encode()).hexdigest())
        return sorted(order[: max(1, min(size, int(k)))])

    def fit(self, df: DataFrame) -> ForestModel:
        rows, labels = prepared(df)
        rows = cut(rows)
        size = rows.select(F.size("x")).first()[0]
        drawn = corpus.bootstrap(rows, self.n_trees, "row_id", self.seed)
        grown: dict[int, trees.Tree] = {}
        # A block of trees at a time bounds the copies of the table in one job.
        for a in range(0, self.n_trees, self.block):
            own = range(a, min(a + self.block, self.n_trees))
            bag = drawn.where(F.col("tree").between(own[0], own[-1])).join(rows, "row_id").select("tree", "x", "y", F.col("times").cast("double").alias("w"))
            grown |= _grown(cut(bag), trees.Gini(len(labels)), self.bins, self.max_depth, self.min_split, 1, features={t: self.subset(t, size) for t in own})
        return ForestModel(labels, [grown[t] for t in sorted(grown)])


@dataclass
class BoostModel(Model):
    start: list[float]
    rate: float
    rounds: list[list[trees.Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def probability(self, x: Column) -> Column:
        k = len(self.labels)
        values = trees.predict_column([t for r in self.rounds for t in r], x) if self.rounds else F.array().cast("array<double>")
        own = lambda c: V.total(F.filter(values, lambda _, i: i % k == c))
        return V.softmax(F.array(*[F.lit(s) + F.lit(self.rate) * own(c) for c, s in enumerate(self.start)]))


@dataclass(frozen=True)
class Boosting:
    """Multiclass boosting; all class trees of a round grow in the same jobs.

    ``kind='residual'``: leaves are mean residuals. ``kind='gradient'``: leaves
    are -G / (H + penalty) and splits take the second-order gain.
    """

    n_rounds: int = 100
    max_depth: int | None = 3
    rate: float = 0.1
    min_split: int = 2
    min_leaf: int = 1
    subsample: float = 1.0
    kind: str = "residual"
    penalty: float = 1.0
    cost: float = 0.0
    least_hessian: float = 1.0
    seed: int = 42
    bins: int | None = growth.BINS

    def fit(self, df: DataFrame) -> BoostModel:
        if self.kind not in ("residual", "gradient"):
            raise ValueError(f"unknown kind of boosting: {self.kind}")
        rows, labels = prepared(df)
        k = len(labels)
        start = {r["y"]: r["f0"] for r in log_priors(rows).collect()}
        model = BoostModel(labels, [start[c] for c in range(k)], self.rate)
        criterion = trees.Gradient(self.penalty, self.cost, self.least_hessian) if self.kind == "gradient" else trees.Variance()
        rows = cut(rows)
        if self.bins:
            drawn = (lambda state, r: corpus.row_subsample(state, self.subsample, k, "row_id", self.seed + r)) if self.subsample < 1 else None
            model.rounds, model.losses = growth.boost(rows, model.start, self.rate, self.n_rounds, criterion, self.max_depth, self.min_split, self.min_leaf, self.bins, drawn)
            return model
        state = rows.withColumn("f", F.array(*[F.lit(s) for s in model.start]))
        for r in range(self.n_rounds):
            chance = state.withColumn("q", V.softmax(F.col("f")))
            flat = chance.select("row_id", "x", "y", F.posexplode("q").alias("tree", "q")).withColumn("hit", (F.col("y") == F.col("tree")).cast("double"))
            if self.kind == "gradient":
                flat = flat.select("row_id", "tree", "x", F.lit(1.0).alias("w"), (F.col("q") - F.col("hit")).alias("g"), (F.col("q") * (1 - F.col("q"))).alias("h"))
            else:
                flat = flat.select("row_id", "tree", "x", F.lit(1.0).alias("w"), (F.col("hit") - F.col("q")).alias("t"))
            if self.subsample < 1:
                drawn = corpus.row_subsample(state, self.subsample, k, "row_id", self.seed + r).withColumnRenamed("grp", "tree")
                flat = flat.join(drawn, ["tree", "row_id"], "left_semi")
            grown = trees.grow(flat.drop("row_id"), criterion, self.max_depth, self.min_split, self.min_leaf)
            model.rounds.append([grown[c] for c in range(k)])
            step = trees.predict_column(model.rounds[-1], F.col("x"))
            state = cut(state.withColumn("f", V.add(F.col("f"), V.scale(step, self.rate))))
            loss = -F.log(F.get(V.softmax(F.col("f")), F.col("y")) + TINY)
            model.losses.append(state.agg(F.avg(loss)).first()[0])
        return model


def gbdt(**own) -> Boosting:
    return Boosting(**own)


def xgb(**own) -> Boosting:
    return Boosting(**({"kind": "gradient", "max_depth": 6} | own))


def lgbm(min_data_in_leaf: int = 20, max_depth: int = -1, **own) -> Boosting:
    """Deep residual trees that stop at small nodes."""
    return Boosting(**({"max_depth": 100 if max_depth < 0 else max_depth, "min_split": min_data_in_leaf} | own))


# ---- naive Bayes -----------------------------------------------------------------


def mnb_counts(df: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Priors ``y, prior`` (unsmoothed) and ``y, idx, logp``; values are shifted by the least one plus 1e-10."""
    flat = long_form(df, "x", "row_id", "y")
    least = flat.agg(F.min("value").alias("least"))
    cells = flat.groupBy("y", "idx").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    shifted = cells.join(F.broadcast(least)).select("y", "idx", (F.col("s") - F.col("n") * (F.col("least") - F.lit(TINY)) + F.lit(alpha)).alias("s"))
    logs = shifted.select("y", "idx", (F.log("s") - F.log(F.sum("s").over(Window.partitionBy("y")))).alias("logp"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    priors = df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("y", (F.col("n") / F.col("total")).alias("prior"))
    return priors, logs


@dataclass
class BayesModel(Model):
    least: float
    log_prior: list[float]
    logs: list[list[float]]

    def probability(self, x: Column) -> Column:
        moved = F.transform(x, lambda v: v - F.lit(self.least - TINY))
        score = [F.lit(p) + V.dot(moved, F.array(*[F.lit(v) for v in own])) for p, own in zip(self.log_prior, self.logs)]
        return V.softmax(F.array(*score))

    def transform(self, df: DataFrame, shift: str = "fit") -> DataFrame:
        """``shift='batch'`` takes the least value of the scored rows instead of the fitted ones."""
        if shift not in ("fit", "batch"):
            raise ValueError(f"unknown shift: {shift}")
        if shift == "batch":
            least = df.select(F.min(F.array_min(F.col("x").cast("array<double>")))).first()[0]
            return BayesModel(self.labels, least if least is not None else self.least, self.log_prior, self.logs).transform(df)
        return super().transform(df)


@dataclass(frozen=True)
class NaiveBayes:
    alpha: float = 1.0

    def fit(self, df: DataFrame) -> BayesModel:
        rows, labels = prepared(df)
        priors, logs = mnb_counts(rows, self.alpha)
        least = rows.agg(F.min(F.array_min("x"))).first()[0]
        prior = {r["y"]: r["prior"] for r in priors.collect()}
        table: dict[int, dict[int, float]] = {}
        for r in logs.collect():
            table.setdefault(r["y"], {})[r["idx"]] = r["logp"]
        return BayesModel(labels, least, [float(np.log(prior[c])) for c in range(len(labels))], [[table[c][i] for i in sorted(table[c])] for c in range(len(labels))])


# ---- linear models ---------------------------------------------------------------


@dataclass
class LinearModel(Model):
    weights: np.ndarray  # classes by features
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    def probability(self, x: Column) -> Column:
        return V.softmax(F.array(*[V.dot(x, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(b)) for w, b in zip(self.weights, self.bias)]))


def gradient_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of the gradient (the bias last) and the loss over some rows."""
    p = growth.softmax(x @ w.T + b)
    loss = float(-np.log(p[np.arange(len(y)), y] + TINY).sum())
    p[np.arange(len(y)), y] -= 1
    return np.c_[p.T @ x, p.sum(axis=0)], loss


def _partial_gradient(w: np.ndarray, b: np.ndarray):
    def run(batches):
        total, n, loss = None, 0, 0.0
        for f in batches:
            if not len(f):
                continue
            x, y = growth.matrix(f["x"]), f["y"].to_numpy()
            g, own = gradient_sums(x, y, w, b)
            loss += own
            total = g if total is None else total + g
            n += len(y)
        if total is not None:
            yield pd.DataFrame({"c": np.arange(len(total)), "g": [r.tolist() for r in total], "n": n, "loss": loss})

    return run


def softmax_gradient(rows: DataFrame, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean gradient of weights and bias and mean loss over all rows; one small matrix per partition is summed."""
    parts = rows.select("x", "y").mapInPandas(_partial_gradient(w, b), "c long, g array<double>, n long, loss double")
    sums = parts.select("c", "n", "loss", F.posexplode("g").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect()
    out = np.zeros((w.shape[0], w.shape[1] + 1))
    for r in sums:
        out[r["c"], r["i"]] = r["v"]
    n = sums[0]["n"]
    return out[:, :-1] / n, out[:, -1] / n, sums[0]["loss"] / n


@dataclass(frozen=True)
class SoftmaxRegression:
    """Batch gradient descent, L2 on weights only, stops when the loss moves less than ``tol``."""

    rate: float = 0.01
    steps: int = 1000
    penalty: float = 0.01
    tol: float = 1e-4
    seed: int = 42
    init: float = 0.01

    def fit(self, df: DataFrame) -> LinearModel:
        rows, labels = prepared(df)
        rows = cut(rows)
        n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        w = np.random.RandomState(self.seed).randn(size, len(labels)).T * self.init
        b = np.zeros(len(labels))
        if n * size > growth.LOCAL_CELLS:
            return LinearModel(labels, *self.descended(lambda w, b: softmax_gradient(rows, w, b), w, b))

        def here(f: pd.DataFrame) -> pd.DataFrame:
            # The same steps in one task; in the order of the ids, so that sums don't depend on the partitions.
            f = f.sort_values("row_id", kind="stable")
            x, y = growth.matrix(f["x"]), f["y"].to_numpy()

            def gradient(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
                g, loss = gradient_sums(x, y, w, b)
                return g[:, :-1] / len(y), g[:, -1] / len(y), loss / len(y)

            v, c, losses = self.descended(gradient, w, b)
            return pd.DataFrame({"w": [v.tobytes()], "b": [c.tobytes()], "losses": [losses]})

        r = rows.select(F.lit(0).alias("g"), "row_id", "x", "y").groupBy("g").applyInPandas(here, "w binary, b binary, losses array<double>").first()
        return LinearModel(labels, np.frombuffer(r["w"]).reshape(len(labels), size), np.frombuffer(r["b"]), list(r["losses"]))

    def descended(self, gradient, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
        losses: list[float] = []
        for _ in range(self.steps):
            gw, gb, loss = gradient(w, b)
            losses.append(loss + 0.5 * self.penalty * float((w * w).sum()))
            if len(losses) > 1 and abs(losses[-1] - losses[-2]) < self.tol:
                break
            w, b = w - self.rate * (gw + self.penalty * w), b - self.rate * gb
        return w, b, losses


@dataclass
class SvmModel(Model):
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def votes(self, x: Column) -> Column:
        """Votes per class; a margin of exactly zero votes for neither."""
        sign = [F.signum(V.dot(x, F.array(*[F.lit(float(v)) for v in w])) + F.lit(float(b))) for w, b in zip(self.weights, self.bias)]
        out = []
        for k in range(len(self.labels)):
            own = F.lit(0.0)
            for (i, j), s in zip(self.pairs, sign):
                if k in (i, j):
                    own = own + F.when(s == (1.0 if k == i else -1.0), 1.0).otherwise(0.0)
            out.append(own)
        return F.array(*out)

    def probability(self, x: Column) -> Column:
        """Share of the votes of all pairs."""
        return F.transform(self.votes(x), lambda v: v / F.lit(float(max(1, len(self.pairs)))))


def hinge_epochs(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]], epochs: int, rate: float, shrink: float, sign: float) -> None:
    """Rows one after another, each a step of all pairs of its class at once; ``w`` and ``b`` change in place."""
    of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in np.unique(y).tolist():
        own = [(k, 1.0 if c == i else -1.0) for k, (i, j) in enumerate(pairs) if c in (i, j)]
        of[c] = np.array([k for k, _ in own]), np.array([t for _, t in own])
    labels = y.tolist()
    keep = 1 - rate * 2 * shrink
    for _ in range(epochs):
        for v, c in zip(x, labels):
            at, t = of[c]
            own = w[at]
            step = rate * t * (t * (own @ v + b[at]) < 1)
            w[at] = keep * own + step[:, None] * v
            b[at] += sign * step


@dataclass(frozen=True)
class PairwiseSvm:
    """Linear hinge SGD for every pair of classes.

    Rows fall into shards of about ``shard_rows`` by the hash of their ids. A
    shard's epochs run over its rows in the order of their ids, in one task; at
    ``rounds`` points the shards' weights are averaged by rows. So the weights
    don't depend on the partitions, and up to ``shard_rows`` rows an epoch is
    sequential over all. ``bias_sign=-1`` turns the bias step round, as some
    implementations do.
    """

    rate: float = 0.001
    epochs: int = 1000
    bias_sign: float = 1.0
    shard_rows: int = 4_096
    rounds: int = 10

    def _epochs(self, w: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]], epochs: int):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("row_id", kind="stable")
            v, c, y = w.copy(), b.copy(), f["y"].to_numpy()
            hinge_epochs(growth.matrix(f["x"]), y, v, c, pairs, epochs, self.rate, 1 / self.epochs, self.bias_sign)
            seen = np.array([((y == i) | (y == j)).sum() for i, j in pairs], np.float64)
            return pd.DataFrame({"k": np.arange(len(pairs)), "n": seen, "v": [(np.append(a, d) * m).tolist() for a, d, m in zip(v, c, seen)]})

        return run

    def fit(self, df: DataFrame) -> SvmModel:
        rows, labels = prepared(df)
        rows = cut(rows)
        n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        shards = max(1, -(-n // self.shard_rows))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
        pairs = class_pairs(labels)
        w, b = np.zeros((len(pairs), size)), np.zeros(len(pairs))
        rounds = 1 if shards == 1 else max(1, min(self.rounds, self.epochs))
        for r in range(rounds):
            epochs = self.epochs * (r + 1) // rounds - self.epochs * r // rounds

            # A row per pair and weight: sums of small tables, however many shards.
            flat = rows.groupBy("shard").applyInPandas(self._epochs(w, b, pairs, epochs), "k int, n double, v array<double>").select("k", "n", F.posexplode("v").alias("i", "v"))
            both = np.c_[w, b]
            for row in flat.groupBy("k", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
                if row["n"]:
                    both[row["k"], row["i"]] = row["v"] / row["n"]
            w, b = both[:, :-1].copy(), both[:, -1].copy()
        return SvmModel(labels, pairs, w, b)


# ---- neighbours ------------------------------------------------------------------


#: Values (rows times features) up to which the training rows go to every task.
SENT_VALUES = 4_000_000
SHARD_ROWS = 65_536
_NEAR = "query_id long, row_id long, similarity double, rank int"


def _directions(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)


def _nearest(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, q: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k most similar of the rows (in the order of their ids) for each query."""
    for a in range(0, len(q), 512):
        s = np.round(q[a : a + 512] @ x.T, 12)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        n = top.shape[1]
        yield pd.DataFrame({"query_id": np.repeat(asks[a : a + 512], n), "row_id": ids[top.ravel()], "similarity": np.take_along_axis(s, top, 1).ravel(), "rank": np.tile(np.arange(1, n + 1, dtype=np.int32), len(top))})


def _ordered(ids: list, x: list) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate(ids)
    order = np.argsort(own, kind="stable")
    return own[order], _directions(np.concatenate(x))[order]


def cosine_neighbours(train: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, row_id, similarity, rank``: the k most similar training rows of each query row.

    Training rows of at most SENT_VALUES values are sent to the tasks of the
    queries, which then needn't be shuffled and may be a stream. More fall into
    shards of about SHARD_ROWS; every shard holds its rows and lets the queries
    pass by in batches, and only the k best of each shard are shuffled. Ties go to
    the smaller id; a row that is also a query is its own neighbour.
    """
    rows = train.where("x is not null").select("row_id", F.col("x").cast("array<double>").alias("x"))
    asks = queries.where("x is not null").select("row_id", F.col("x").cast("array<double>").alias("x"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n:
        return asks.where("false").selectExpr("row_id as query_id", "row_id", "0.0D as similarity", "0 as rank")
    if n * size <= SENT_VALUES:
        held = rows.toPandas()
        sent = train.sparkSession.sparkContext.broadcast(_ordered([held["row_id"].to_numpy()], [growth.matrix(held["x"])]))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield from _nearest(*sent.value, b["row_id"].to_numpy(), _directions(growth.matrix(b["x"])), k)

        return asks.mapInPandas(ask, _NEAR)
    shards = -(-n // SHARD_ROWS)
    placed = rows.select(F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "row_id", "x")
    asked = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "row_id", "x")
    both = placed.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("asks")

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, known = [], [], None
        for b in batches:
            own, q = b[b["asks"] == 0], b[b["asks"] == 1]
            if len(own):
                ids.append(own["row_id"].to_numpy())
                x.append(growth.matrix(own["x"]))
            if len(q) and ids:
                known = known or _ordered(ids, x)
                yield from _nearest(*known, q["row_id"].to_numpy(), _directions(growth.matrix(q["x"])), k)

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id"))
    return both.mapInPandas(passing, _NEAR).withColumn("rank", best).where(F.col("rank") <= k)


def neighbour_vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """``query_id, p``: the most frequent label among the neighbours, the smaller on ties."""
    votes = near.join(labels.select("row_id", "y"), "row_id").groupBy("query_id", "y").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "y"))
    return votes.withColumn("r", first).where("r = 1").select("query_id", F.col("y").alias("p"))


@dataclass
class NeighbourModel:
    labels: list
    rows: DataFrame
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        near = cosine_neighbours(self.rows, df, self.k).join(self.rows.select("row_id", "y"), "row_id")
        counts = near.groupBy("query_id").agg(F.array(*[F.sum(F.when(F.col("y") == i, 1.0).otherwise(0.0)) / F.count(F.lit(1)) for i in range(len(self.labels))]).alias("probability"))
        named = counts.withColumn("p", F.get(F.array(*[F.lit(c) for c in self.labels]), V.argmax(F.col("probability"))))
        return df.join(named.withColumnRenamed("query_id", "row_id"), "row_id", "left")


@dataclass(frozen=True)
class Neighbours:
    k: int = 5

    def fit(self, df: DataFrame) -> NeighbourModel:
        rows, labels = prepared(df)
        return NeighbourModel(labels, rows, self.k)


#: Base models by name; further ones may be added.
REGISTRY = {
    "naive_bayes": NaiveBayes,
    "svm": PairwiseSvm,
    "knn": Neighbours,
    "logistic_regression": SoftmaxRegression,
    "random_forest": RandomForest,
    "gbdt": gbdt,
    "xgboost": xgb,
    "lightgbm": lgbm,
    "decision_tree": DecisionTree,
}


def base_model(name: str, **own):
    if name not in REGISTRY:
        raise ValueError(f"unknown model: {name}")
    return REGISTRY[name](**own)
