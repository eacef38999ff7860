"""Exact decision trees, grown level by level over all rows.

Rows have ``tree``, ``x`` (array of doubles), ``w`` (weight) and their targets.
A level is one job for all open nodes of all trees: statistics are summed per
node, feature and distinct value (before the shuffle), prefix sums over the
values give each threshold's left side, and the best threshold per node reaches
the driver, one row a node. Thresholds are exact, and a window has a row per
distinct value of a feature in a node; ``growth`` bounds that by bins.

A split sends ``x[feature] <= threshold`` left; NaN and null go right. Ties of
gain (12 digits) go to the smaller feature, then the smaller threshold. Defined
cases: rows with a null vector are left out; one class, one row or constant
features give a single leaf; an empty table raises.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.functions import vectors as V
from wenloom.sources.tables import cut

#: Above this many nodes the generated code, which models repeat per label, would pass the limit of a method.
MAX_CASE_NODES = 40


@dataclass
class Node:
    value: float | int
    feature: int = -1
    threshold: float = 0.0


@dataclass
class Tree:
    """Nodes by number; the children of i are 2i and 2i + 1, the root is 1."""

    nodes: dict[int, Node] = field(default_factory=dict)

    def column(self, x: Column, at: int = 1) -> Column:
        n = self.nodes[at]
        if n.feature < 0:
            return F.lit(n.value)
        v = F.get(x, F.lit(n.feature))
        return F.when((v <= F.lit(n.threshold)) & ~F.isnan(v), self.column(x, 2 * at)).otherwise(self.column(x, 2 * at + 1))

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Values of the rows of a matrix."""
        out = np.zeros(len(x), np.float64)
        open_ = {1: np.arange(len(x))}
        while open_:
            node, rows = open_.popitem()
            n = self.nodes[node]
            if n.feature < 0:
                out[rows] = n.value
                continue
            with np.errstate(invalid="ignore"):
                left = x[rows, n.feature] <= n.threshold
            open_[2 * node], open_[2 * node + 1] = rows[left], rows[~left]
        return out

    def table(self) -> list[tuple]:
        return [(i, n.feature, float(n.threshold), n.feature < 0, float(n.value)) for i, n in sorted(self.nodes.items())]

    @staticmethod
    def of(rows: list) -> Tree:
        return Tree({int(r[0]): Node(r[4], int(r[1]), r[2]) for r in rows})


def predict_column(trees: list[Tree], x: Column) -> Column:
    """``array<double>`` with each tree's value, null for a null vector: generated CASE for small trees, Arrow batches for large ones."""
    if sum(len(t.nodes) for t in trees) <= MAX_CASE_NODES:
        return F.when(x.isNotNull(), F.array(*[t.column(x).cast("double") for t in trees]))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def walk(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), object)
        known = np.flatnonzero(v.notna())
        if len(known):
            m = np.stack(v.to_numpy()[known])
            for i, y in zip(known, np.stack([t.walk(m) for t in trees], axis=1)):
                out[i] = y
        return pd.Series(out)

    return walk(x.cast("array<double>"))


# ---- statistics and gains ---------------------------------------------------------


@dataclass(frozen=True)
class Gini:
    """Class counts; targets in ``y``: 0 .. classes - 1."""

    classes: int

    def sums(self) -> dict[str, Column]:
        return {"n": F.sum("w")} | {f"c{k}": F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)) for k in range(self.classes)}

    def impurity(self, s: dict[str, Column]) -> Column:
        rest = F.lit(1.0)
        for k in range(self.classes):
            rest = rest - F.pow(s[f"c{k}"] / s["n"], 2)
        return rest

    def gain(self, a: dict[str, Column], left: dict[str, Column], right: dict[str, Column]) -> Column:
        return self.impurity(a) - left["n"] / a["n"] * self.impurity(left) - right["n"] / a["n"] * self.impurity(right)

    def allowed(self, left: dict[str, Column], right: dict[str, Column], least: int) -> Column:
        return (left["n"] >= least) & (right["n"] >= least)

    @property
    def width(self) -> int:
        return self.classes

    def stats(self, b: pd.DataFrame) -> np.ndarray:
        return b["w"].to_numpy(np.float64)[:, None] * (b["y"].to_numpy()[:, None] == np.arange(self.classes))

    def rows(self, total: np.ndarray) -> float:
        return float(total.sum())

    def single(self, total: np.ndarray) -> bool:
        return int((total > 0).sum()) <= 1

    def leaf(self, total: np.ndarray) -> int:
        return int(np.argmax(total))

    def gains(self, total: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
        right = total - left
        n, a, b = total.sum(), left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda s, m: m / n * (1 - ((s / m[:, None]) ** 2).sum(axis=1))
            gain = 1 - ((total / n) ** 2).sum() - part(left, a) - part(right, b)
        return np.where((a >= least) & (b >= least) & (b > 0), gain, -np.inf)

    #: Whether the first statistic is the rows' weight.
    counts_rows = False

    def gains_of(self, total: np.ndarray, left: list[np.ndarray], least: int) -> np.ndarray:
        return self.gains(total, np.stack([s.ravel() for s in left]).T, least).reshape(left[0].shape)

    def value(self, r) -> int:
        counts = [r[f"t_c{k}"] for k in range(self.classes)]
        return counts.index(max(counts))

    def pure(self, r) -> bool:
        return sum(r[f"t_c{k}"] > 0 for k in range(self.classes)) <= 1


@dataclass(frozen=True)
class Variance:
    """Squared error; targets in ``t``."""

    def sums(self) -> dict[str, Column]:
        return {"n": F.sum("w"), "s": F.sum(F.col("w") * F.col("t")), "q": F.sum(F.col("w") * F.col("t") * F.col("t"))}

    def impurity(self, s: dict[str, Column]) -> Column:
        return s["q"] / s["n"] - F.pow(s["s"] / s["n"], 2)

    gain = Gini.gain
    allowed = Gini.allowed
    width = 2

    def stats(self, b: pd.DataFrame) -> np.ndarray:
        w = b["w"].to_numpy(np.float64)
        return np.stack([w, w * b["t"].to_numpy(np.float64)], axis=1)

    def rows(self, total: np.ndarray) -> float:
        return float(total[0])

    def single(self, total: np.ndarray) -> bool:
        return False

    def leaf(self, total: np.ndarray) -> float:
        return float(total[1] / total[0])

    def gains(self, total: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
        return self.gains_of(total, list(left.T), least)

    counts_rows = True

    def gains_of(self, total: np.ndarray, left: list[np.ndarray], least: int) -> np.ndarray:
        """Sums to the left one by one; the weights may be a row for all features."""
        n, s = left
        m, t = total[0] - n, total[1] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s
            gain /= n
            t *= t
            t /= m
            gain += t
            gain /= total[0]
            gain -= (total[1] / total[0]) ** 2
        np.copyto(gain, -np.inf, where=~((n >= least) & (m >= least) & (m > 0)))
        return gain

    def value(self, r) -> float:
        return r["t_s"] / r["t_n"]

    def pure(self, r) -> bool:
        return False


@dataclass(frozen=True)
class Gradient:
    """Second-order gain; targets in ``g`` and ``h``."""

    penalty: float = 1.0
    cost: float = 0.0
    least_hessian: float = 1.0
    width = 3

    def stats(self, b: pd.DataFrame) -> np.ndarray:
        w = b["w"].to_numpy(np.float64)
        return np.stack([w, w * b["g"].to_numpy(np.float64), w * b["h"].to_numpy(np.float64)], axis=1)

    rows = Variance.rows
    single = Variance.single

    def leaf(self, total: np.ndarray) -> float:
        return float(-total[1] / (total[2] + self.penalty))

    def gains(self, total: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
        return self.gains_of(total, list(left.T), least)

    counts_rows = True

    def gains_of(self, total: np.ndarray, left: list[np.ndarray], least: int) -> np.ndarray:
        n, g, h = left
        score = lambda a, b: a * a / (b + self.penalty)
        gain = 0.5 * (score(g, h) + score(total[1] - g, total[2] - h) - score(total[1], total[2])) - self.cost
        fine = (n > 0) & (total[0] - n > 0) & (h >= self.least_hessian) & (total[2] - h >= self.least_hessian)
        return np.where(fine, gain, -np.inf)

    def sums(self) -> dict[str, Column]:
        return {"n": F.sum("w"), "g": F.sum(F.col("w") * F.col("g")), "h": F.sum(F.col("w") * F.col("h"))}

    def score(self, s: dict[str, Column]) -> Column:
        return s["g"] * s["g"] / (s["h"] + F.lit(self.penalty))

    def gain(self, a: dict[str, Column], left: dict[str, Column], right: dict[str, Column]) -> Column:
        return F.lit(0.5) * (self.score(left) + self.score(right) - self.score(a)) - F.lit(self.cost)

    def allowed(self, left: dict[str, Column], right: dict[str, Column], least: int) -> Column:
        return (left["n"] > 0) & (right["n"] > 0) & (left["h"] >= self.least_hessian) & (right["h"] >= self.least_hessian)

    def value(self, r) -> float:
        return -r["t_g"] / (r["t_h"] + self.penalty)

    def pure(self, r) -> bool:
        return False


Criterion = Gini | Variance | Gradient


def leaf_column(criterion: Criterion, s: dict[str, Column]) -> Column:
    """The value of a leaf with these sums."""
    if isinstance(criterion, Gini):
        return V.argmax(F.array(*[s[f"c{k}"] for k in range(criterion.classes)]))
    return s["s"] / s["n"] if isinstance(criterion, Variance) else -s["g"] / (s["h"] + F.lit(criterion.penalty))


def summary(rows: DataFrame, by: list[str], criterion: Criterion) -> DataFrame:
    """``by, rows, impurity, leaf``: what groups of rows with ``w`` and targets would be as leaves (no impurity by gradients)."""
    sums = criterion.sums()
    own = rows.groupBy(*by).agg(*[c.cast("double").alias(f"__{k}") for k, c in sums.items()])
    s = {k: F.col(f"__{k}") for k in sums}
    impurity = F.lit(None).cast("double") if isinstance(criterion, Gradient) else criterion.impurity(s)
    return own.select(*by, s["n"].alias("rows"), impurity.alias("impurity"), leaf_column(criterion, s).alias("leaf"))


def split_gains(flat: DataFrame, by: list[str], criterion: Criterion, min_leaf: int = 1) -> DataFrame:
    """``by, idx, value, gain, t_*``: the gain of each threshold (null if not allowed) and the node's totals."""
    sums = criterion.sums()
    cells = flat.groupBy(*by, "idx", "value").agg(*[c.cast("double").alias(k) for k, c in sums.items()])
    ahead = Window.partitionBy(*by, "idx").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "idx")
    run = cells.select("*", *[F.sum(k).over(ahead).alias(f"l_{k}") for k in sums], *[F.sum(k).over(whole).alias(f"t_{k}") for k in sums])
    left, total = {k: F.col(f"l_{k}") for k in sums}, {k: F.col(f"t_{k}") for k in sums}
    right = {k: total[k] - left[k] for k in sums}
    fine = criterion.allowed(left, right, min_leaf) & (right["n"] > 0)
    return run.select(*by, "idx", "value", F.when(fine, F.round(criterion.gain(total, left, right), 12)).alias("gain"), *[f"t_{k}" for k in sums])


def best_splits(flat: DataFrame, by: list[str], criterion: Criterion, min_leaf: int = 1) -> DataFrame:
    """The first best threshold of each node, by gain, feature and threshold."""
    gains = split_gains(flat, by, criterion, min_leaf)
    order = Window.partitionBy(*by).orderBy(F.col("gain").desc_nulls_last(), "idx", "value")
    best = Window.partitionBy(*by, "idx").orderBy(F.col("gain").desc_nulls_last(), "value")
    # The best of each feature first, so that the last window has a row per feature.
    per_feature = gains.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return per_feature.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def grow(rows: DataFrame, criterion: Criterion, max_depth: int | None = None, min_split: int = 2, min_leaf: int = 1, features: dict[int, list[int]] | None = None) -> dict[int, Tree]:
    """Trees by number. ``features``: which features a tree may use; None for all. Nodes are in binary digits, for any depth."""
    rows = rows.where("x is not null").withColumn("node", F.lit("1"))
    trees: dict[int, Tree] = {}
    depth = 0
    while True:
        flat = rows.select(*[c for c in rows.columns if c != "x"], F.posexplode("x").alias("idx", "value")).where("not isnan(value)")
        if features is not None:
            own = F.create_map(*[y for t, f in features.items() for y in (F.lit(t), F.array(*[F.lit(i) for i in f]))])
            flat = flat.where(F.array_contains(F.try_element_at(own, F.col("tree")), F.col("idx")))
        found = best_splits(flat, ["tree", "node"], criterion, min_leaf).collect()
        if not found and not trees:
            raise ValueError("no rows to grow a tree on")
        splits = []
        for r in found:
            tree = trees.setdefault(r["tree"], Tree())
            node = Node(criterion.value(r))
            stop = (max_depth is not None and depth >= max_depth) or r["t_n"] < min_split or criterion.pure(r) or r["gain"] is None or r["gain"] <= 0
            if not stop:
                node.feature, node.threshold = r["idx"], r["value"]
                splits.append((r["tree"], r["node"], r["idx"], r["value"]))
            tree.nodes[int(r["node"], 2)] = node
        if not splits:
            return trees
        # A row per open node: no more than the driver already holds.
        table = rows.sparkSession.createDataFrame(splits, "tree int, node string, feature int, threshold double")
        moved = rows.join(F.broadcast(table), ["tree", "node"])
        v = F.get("x", F.col("feature"))
        left = (v <= F.col("threshold")) & ~F.isnan(v)
        rows = cut(moved.withColumn("node", F.concat("node", F.when(left, "0").otherwise("1"))).drop("feature", "threshold"))
        depth += 1


def save(spark: SparkSession, trees: dict[int, Tree], path: str, **about) -> None:
    rows = [(t, str(n[0]), *n[1:]) for t, tree in trees.items() for n in tree.table()]
    spark.createDataFrame(rows, "tree int, node string, feature int, threshold double, leaf boolean, value double").withColumn("about", F.lit(json.dumps(about))).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[dict[int, Tree], dict]:
    rows = spark.read.parquet(path).orderBy("tree", "node").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["leaf"], r["value"]))
    return {t: Tree.of(n) for t, n in out.items()}, json.loads(rows[0]["about"])
