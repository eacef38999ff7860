"""Scaling, projection and fusion of dense features.

Tables hold ``row_id`` and an array of doubles. Fits are aggregations over all
rows; only tables of one row per dimension, or per pair of dimensions, reach
the driver. Defined cases: null vectors are left out of fits and stay null;
constant columns have scale one; an empty fit raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.functions import vectors as V


def long_form(df: DataFrame, vector: str = "x", row_id: str = "row_id", *more: str) -> DataFrame:
    """``row_id, idx, value`` and further columns."""
    return df.select(row_id, *more, F.posexplode(F.col(vector)).alias("idx", "value"))


def zscore_fit(df: DataFrame, vector: str = "x") -> DataFrame:
    """``idx, mean, std`` with the population deviation."""
    flat = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("idx", "value"))
    return flat.groupBy("idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / scale, element by element."""

    shift: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, df: DataFrame, vector: str = "x", out: str = "x") -> DataFrame:
        moved = F.zip_with(F.col(vector).cast("array<double>"), _literal(self.shift), lambda x, m: x - m)
        return df.withColumn(out, F.zip_with(moved, _literal(self.scale), lambda x, s: x / s))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(self.shift, self.scale))]
        spark.createDataFrame(rows, "idx int, shift double, scale double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).orderBy("idx").collect()
        return Scaler(tuple(r["shift"] for r in rows), tuple(r["scale"] for r in rows))


def fit_scaler(df: DataFrame, vector: str = "x", kind: str = "zscore") -> Scaler:
    """``zscore`` or ``minmax``; fit on the training rows only."""
    if kind not in ("zscore", "minmax"):
        raise ValueError(f"unknown kind of scaling: {kind}")
    flat = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("idx", "value"))
    low, span = (F.avg("value"), F.stddev_pop("value")) if kind == "zscore" else (F.min("value"), F.max("value") - F.min("value"))
    rows = flat.groupBy("idx").agg(low.alias("a"), span.alias("b")).orderBy("idx").collect()
    if not rows:
        raise ValueError("nothing to fit a scaler on")
    return Scaler(tuple(r["a"] for r in rows), tuple(r["b"] or 1.0 for r in rows))


def fuse(families: dict[str, DataFrame], weights: dict[str, float], align: str = "equal", row_id: str = "row_id", vector: str = "x") -> DataFrame:
    """``row_id, x``: the weighted sum of each row's vectors; rows that all families have.

    ``align='pad'`` fills shorter vectors with zeros.
    """
    if align not in ("equal", "pad"):
        raise ValueError(f"unknown alignment: {align}")
    out = None
    for name, df in families.items():
        own = df.select(row_id, V.scale(F.col(vector).cast("array<double>"), weights[name]).alias(name))
        out = own if out is None else out.join(own, row_id)
    cols = [F.col(n) for n in families]
    if align == "pad":
        most = F.greatest(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])
        cols = [F.concat(c, F.array_repeat(F.lit(0.0), most - F.size(c))) for c in cols]
    return out.select(row_id, V.weighted_sum(cols, [1.0] * len(cols)).alias("x"))


def weight_grid(spark: SparkSession, step: float = 0.1) -> DataFrame:
    """``w1, w2, w3``: all triples of multiples of the step that sum to one."""
    n = int(1 / step + 1e-9)
    level = lambda c: spark.range(n + 1).select(F.col("id").alias(c))
    grid = level("i").join(F.broadcast(level("j")), F.col("i") + F.col("j") <= n)
    third = F.lit(n) - F.col("i") - F.col("j")
    w = lambda c: F.round(c * F.lit(step), 6)
    return grid.select(w(F.col("i")).alias("w1"), w(F.col("j")).alias("w2"), w(third).alias("w3")).where(F.abs(F.col("w1") + F.col("w2") + F.col("w3") - 1) < 1e-6)


def covariance(df: DataFrame, vector: str = "x") -> DataFrame:
    """``i, j, cov`` for i <= j, with n - 1; products are summed within each row, nothing is joined."""
    v = F.col(vector).cast("array<double>")
    pairs = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda b, j: F.struct(i.alias("i"), (i + j).alias("j"), a.alias("a"), b.alias("b")))))
    flat = df.select(F.explode(pairs).alias("p")).select("p.*")
    return flat.groupBy("i", "j").agg(F.covar_samp("a", "b").alias("cov"))


def gram(df: DataFrame, vector: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred scatter matrix: one small matrix per partition is added up."""
    def run(batches):
        total = None
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(np.float64) if len(b) else None
            if x is None:
                continue
            y = np.c_[np.ones(len(x)), x]
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pd.DataFrame([(i, row.tolist()) for i, row in enumerate(total)], columns=["i", "row"])

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(run, "i int, row array<double>")
    flat = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not flat:
        raise ValueError("nothing to fit on")
    d = max(r["i"] for r in flat) + 1
    m = np.zeros((d, d))
    for r in flat:
        m[r["i"], r["j"]] = r["v"]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return int(n), mean, m[1:, 1:] - n * np.outer(mean, mean)


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    components: np.ndarray  # one row each
    variance: np.ndarray
    ratio: np.ndarray

    def transform(self, df: DataFrame, vector: str = "x", out: str = "x") -> DataFrame:
        v = F.zip_with(F.col(vector).cast("array<double>"), _literal(self.mean), lambda x, m: x - m)
        return df.withColumn(out, _project(v, self.components))

    def inverse(self, df: DataFrame, vector: str = "x", out: str = "x") -> DataFrame:
        back = _project(F.col(vector).cast("array<double>"), self.components.T)
        return df.withColumn(out, F.zip_with(back, _literal(self.mean), lambda x, m: x + m))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(v), float(r), c.tolist()) for i, (v, r, c) in enumerate(zip(self.variance, self.ratio, self.components))]
        rows.append((-1, 0.0, 0.0, self.mean.tolist()))
        spark.createDataFrame(rows, "k int, variance double, ratio double, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Pca:
        rows = spark.read.parquet(path).orderBy("k").collect()
        rest = rows[1:]
        return Pca(np.array(rows[0]["x"]), np.array([r["x"] for r in rest]), np.array([r["variance"] for r in rest]), np.array([r["ratio"] for r in rest]))


def _project(v: Column, rows: np.ndarray) -> Column:
    """Matrix times vector by one Arrow batch multiplication."""
    m = np.ascontiguousarray(rows.T)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def times(x: pd.Series) -> pd.Series:
        out = np.empty(len(x), object)
        known = np.flatnonzero(x.notna())
        if len(known):
            for i, y in zip(known, np.stack(x.to_numpy()[known]) @ m):
                out[i] = y
        return pd.Series(out)

    return times(v)


def fit_pca(df: DataFrame, k: int, vector: str = "x") -> Pca:
    """Components by falling variance; the loading largest in size is positive; k is cut to the rank's bound."""
    n, mean, scatter = gram(df, vector)
    values, columns = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][: min(k, n, len(values))]
    total = max(float(np.clip(values, 0, None).sum()), 1e-300)
    parts = columns[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    kept = np.clip(values[order], 0, None)
    return Pca(mean, parts, kept / max(n - 1, 1), kept / total)


def sparse_rows(coo: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, at, value`` arrays from the long form; rows without a cell are left out."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return coo.groupBy(row_id).agg(cells.alias("c")).select(row_id, F.transform("c", lambda c: c["idx"].cast("int")).alias("at"), F.transform("c", lambda c: c["value"]).alias("value"))


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = b["at"].map(len).to_numpy()
    return np.concatenate(b["at"].to_numpy()).astype(np.int64), np.concatenate(b["value"].to_numpy()), np.repeat(np.arange(len(b)), size)


def _row_sums(rows: DataFrame, work, size: int) -> np.ndarray:
    """Sum over all partitions of a matrix with ``size`` rows."""

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                m = work(b)
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": [r.tobytes() for r in total]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [b["i"].iloc[0]], "row": [sum(np.frombuffer(r) for r in b["row"]).tobytes()]})

    out: np.ndarray | None = None
    for i, row in rows.mapInPandas(run, "i int, row binary").groupBy("i").applyInPandas(add, "i int, row binary").collect():
        own = np.frombuffer(row)
        if out is None:
            out = np.zeros((size, len(own)))
        out[i] = own
    if out is None:
        raise ValueError("nothing to fit on")
    return out


def fit_sparse_pca(rows: DataFrame, n_rows: int, n_features: int, k: int, passes: int = 4, seed: int = 42) -> Pca:
    """Leading components of sparse rows by subspace iteration; nothing is densified.

    Only matrices of features by components reach the driver. The ratios are
    shares of the total variance of all features.
    """
    k = min(k, n_features, n_rows)

    def moments(b: pd.DataFrame) -> np.ndarray:
        at, value, _ = _flat(b)
        return np.c_[np.bincount(at, value, n_features), np.bincount(at, value * value, n_features)]

    first = _row_sums(rows.select("at", "value"), moments, n_features)
    mean = first[:, 0] / n_rows
    total = float(first[:, 1].sum() - n_rows * (mean * mean).sum())
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, min(n_features, k + 8))))[0]
    for _ in range(passes):

        def work(b: pd.DataFrame, basis: np.ndarray = basis) -> np.ndarray:
            at, value, row = _flat(b)
            inner = np.zeros((len(b), basis.shape[1]))
            np.add.at(inner, row, basis[at] * value[:, None])
            out = np.zeros(basis.shape)
            np.add.at(out, at, inner[row] * value[:, None])
            return out

        image = _row_sums(rows.select("at", "value"), work, n_features) - n_rows * np.outer(mean, mean @ basis)
        basis = np.linalg.qr(image)[0]
    values, turn = np.linalg.eigh(basis.T @ (_row_sums(rows.select("at", "value"), lambda b, basis=basis: work(b, basis), n_features) - n_rows * np.outer(mean, mean @ basis)))
    order = np.argsort(values)[::-1][:k]
    parts = (basis @ turn[:, order]).T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    kept = np.clip(values[order], 0, None)
    return Pca(mean, parts, kept / max(n_rows - 1, 1), kept / max(total, 1e-300))


def project_sparse(rows: DataFrame, fitted: Pca, out: str = "x") -> DataFrame:
    """``row_id, x``: components of sparse rows."""
    m, shift = np.ascontiguousarray(fitted.components.T), fitted.mean @ fitted.components.T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def times(at: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([v @ m[a] - shift for a, v in zip(at, value)])

    return rows.select("row_id", times("at", "value").alias(out))


def cumulative(spark: SparkSession, ratio: np.ndarray, least: float = 0.95) -> DataFrame:
    """``k, ratio, cumulative, enough``: enough marks the first k that reaches the least."""
    run = np.cumsum(ratio)
    first = int(np.argmax(run >= least)) + 1 if len(run) and run[-1] >= least else 0
    return spark.createDataFrame([(i + 1, float(a), float(b), i + 1 == first) for i, (a, b) in enumerate(zip(ratio, run))], "k int, ratio double, cumulative double, enough boolean")


def ml_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def joined_families(families: dict[str, DataFrame], labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows that all families (``row_id`` and a column of the family's name) and the labels have."""
    out = None
    for df in families.values():
        out = df if out is None else out.join(df, row_id)
    return out.join(labels, row_id)


def squared_error(df: DataFrame, vector: str, other: str, row_id: str = "row_id") -> DataFrame:
    """``idx, mse``: mean squared difference of two vector columns by dimension."""
    gap = F.zip_with(F.col(vector), F.col(other), lambda a, b: (a - b) * (a - b))
    return df.select(row_id, F.posexplode(gap).alias("idx", "e")).groupBy("idx").agg(F.avg("e").alias("mse"))


def differences(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How two columns ``a`` and ``b`` differ, and where ``a`` lies."""
    gap = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy(*by).agg(
        F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.median(gap).alias("median_diff"), F.corr("a", "b").alias("corr"), F.min("a").alias("low"), F.max("a").alias("high"), F.stddev_pop("a").alias("std")
    )


def compared_with_ml(df: DataFrame, k: int) -> DataFrame:
    """Components scores of ``fit_pca`` and of Spark's own PCA, signs aligned: ``differences`` by component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = df.where("x is not null").select("row_id", F.col("x").cast("array<double>").alias("x"))
    fitted = fit_pca(rows, k)
    theirs = PCA(k=k, inputCol="v", outputCol="z").fit(rows.select(ml_vector("x").alias("v")))
    parts = np.array(theirs.pc.toArray()).T
    sign = np.sign((parts * fitted.components).sum(axis=1))
    shift = parts @ fitted.mean
    own = fitted.transform(rows, out="a").select("row_id", "a", ml_vector("x").alias("v"))
    z = theirs.transform(own).select("row_id", "a", vector_to_array("z").alias("z"))
    aligned = F.zip_with(F.zip_with("z", _literal(shift), lambda x, m: x - m), _literal(sign), lambda x, s: x * s)
    pairs = z.select(F.posexplode(F.arrays_zip(F.col("a"), aligned.alias("b"))).alias("idx", "p")).select("idx", "p.a", "p.b")
    return differences(pairs, ["idx"])


def properties(df: DataFrame, k: int) -> DataFrame:
    """``property, value``: what must hold of a PCA of all components and of one of ``k``.

    ``orthonormal``: largest entry of the components' Gram matrix less the identity.
    ``variance``: sum of all components' variances, the trace of the covariance.
    ``reconstruction``: squared error per row of k components less the dropped variance.
    """
    rows = df.where("x is not null").select("row_id", F.col("x").cast("array<double>").alias("x"))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    whole = fit_pca(rows, size)
    c = whole.components
    few = fit_pca(rows, k)
    back = few.inverse(few.transform(rows, out="z"), "z", "back")
    error = squared_error(back, "x", "back").agg(F.sum("mse")).first()[0]
    dropped = float(whole.variance[k:].sum()) * (n - 1) / n
    out = [("orthonormal", float(np.abs(c @ c.T - np.eye(len(c))).max())), ("variance", float(whole.variance.sum())), ("reconstruction", abs(error - dropped))]
    return df.sparkSession.createDataFrame(out, "property string, value double")
