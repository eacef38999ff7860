"""A transformer text encoder, run over Arrow batches.

Weights are a dict of arrays: loaded from an ``.npz`` file or drawn with a fixed
seed (there is no network here); they travel once per executor as a broadcast
variable, whose size the configuration fixes. Defined cases: null and empty
texts encode the two boundary tokens; long texts are cut after the closing
token is added; a row's vector doesn't depend on its batch, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wenloom.functions.text import characters, encode_characters

MASKED = -10000.0
TINY = 1e-12
WAVES = 3
PLACES = 256
#: Rows of one batch of vectors.
OUT_ROWS = 4_096


@dataclass(frozen=True)
class EncoderConfig:
    vocab: int = 21128
    width: int = 768
    layers: int = 12
    heads: int = 12
    inner: int = 3072
    length: int = 128
    types: int = 2

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        w = self.width
        out: dict[str, tuple[int, ...]] = {"word": (self.vocab, w), "place": (self.length, w), "type": (self.types, w), "norm.scale": (w,), "norm.shift": (w,), "pool.weight": (w, w), "pool.bias": (w,)}
        for i in range(self.layers):
            for part, shape in (("query", (w, w)), ("key", (w, w)), ("value", (w, w)), ("out", (w, w)), ("up", (w, self.inner)), ("down", (self.inner, w))):
                out[f"{i}.{part}.weight"], out[f"{i}.{part}.bias"] = shape, (shape[1],)
            for part in ("after_attention", "after_inner"):
                out[f"{i}.{part}.scale"], out[f"{i}.{part}.shift"] = (w,), (w,)
        return out


def random_weights(c: EncoderConfig, seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    fixed = {"scale": 1.0, "shift": 0.0, "bias": 0.0}
    return {k: np.full(s, fixed[k.rpartition(".")[2]], np.float32) if k.rpartition(".")[2] in fixed else (rng.standard_normal(s) * 0.02).astype(np.float32) for k, s in c.shapes.items()}


def load_weights(c: EncoderConfig, path: str | None, seed: int = 42) -> dict[str, np.ndarray]:
    """From a file; without one, or if its arrays don't fit, random ones."""
    try:
        with np.load(path) as f:
            own = {k: f[k].astype(np.float32) for k in c.shapes}
    except (OSError, KeyError, TypeError, ValueError):
        return random_weights(c, seed)
    return own if all(own[k].shape == s for k, s in c.shapes.items()) else random_weights(c, seed)


def normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    x /= np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / x.shape[-1] + TINY)
    x *= scale
    x += shift
    return x


def gelu(h: np.ndarray) -> np.ndarray:
    """By tanh; in place where it can be."""
    t = h * h
    t *= 0.044715
    t += 1
    t *= h
    t *= sqrt(2 / pi)
    np.tanh(t, out=t)
    t += 1
    t *= h
    t *= 0.5
    return t


def projected(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """One product for all texts and places."""
    out = x.reshape(-1, x.shape[-1]) @ w[f"{name}.weight"]
    out += w[f"{name}.bias"]
    return out.reshape(*x.shape[:-1], -1)


def inner(x: np.ndarray, w: dict[str, np.ndarray], layer: int) -> np.ndarray:
    """The two wide products, by as many places as caches hold."""
    flat = x.reshape(-1, x.shape[-1])
    return np.concatenate([projected(gelu(projected(flat[i : i + PLACES], w, f"{layer}.up")), w, f"{layer}.down") for i in range(0, len(flat), PLACES)]).reshape(x.shape)


def attention(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], layer: int, heads: int, asking: int | None = None) -> np.ndarray:
    """``asking``: how many first places are wanted; None for all."""
    n, _, width = x.shape
    split = lambda v, p: projected(v, w, f"{layer}.{p}").reshape(n, v.shape[1], heads, -1).transpose(0, 2, 1, 3)
    q, k, v = split(x[:, :asking], "query"), split(x, "key"), split(x, "value")
    score = q @ k.transpose(0, 1, 3, 2)
    score *= 1 / sqrt(width / heads)
    score += ((1 - mask) * MASKED).astype(x.dtype)[:, None, None, :]
    score -= score.max(axis=-1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=-1, keepdims=True)
    mixed = (score @ v).transpose(0, 2, 1, 3).reshape(n, -1, width)
    return projected(mixed, w, f"{layer}.out")


def forward(ids: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], c: EncoderConfig, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hidden states of all places (``first``: of the first one only), and the pooled first one; in the weights' precision."""
    x = w["word"][np.where(ids < c.vocab, ids, 0)] + w["place"][: ids.shape[1]] + w["type"][0]
    x = normed(x, w["norm.scale"], w["norm.shift"])
    for i in range(c.layers):
        # The last layer's other places reach nothing.
        asking = 1 if first and i == c.layers - 1 else None
        x = normed(x[:, :asking] + attention(x, mask, w, i, c.heads, asking), w[f"{i}.after_attention.scale"], w[f"{i}.after_attention.shift"])
        x = normed(x + inner(x, w, i), w[f"{i}.after_inner.scale"], w[f"{i}.after_inner.shift"])
    x = x[:, :1] if first else x
    return x, np.tanh(x[:, 0] @ w["pool.weight"] + w["pool.bias"])


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to line number, counted from 0; a vocabulary file is small."""
    lines = spark.read.text(path, wholetext=True).first()
    return {t.strip(): i for i, t in enumerate((lines[0] if lines else "").split("\n")) if t.strip()}


def corpus_vocabulary(df: DataFrame, text: str = "text", first: int = 200) -> dict[str, int]:
    """Every character of the texts to its id, by code point; at most one entry a code point."""
    each = df.where(F.col(text).isNotNull()).select(F.explode(characters(F.col(text))).alias("c")).distinct()
    return {c: first + i for i, c in enumerate(sorted(r["c"] for r in each.collect()))}


def ids_of(text: str | None, vocab: dict[str, int], length: int, unknown: int = 100, first: int = 101, last: int = 102) -> list[int]:
    """As ``encode_characters``, without the padding; for vocabularies too large for a map column."""
    return [first, *[vocab.get(c, unknown) for c in text or ""], last][:length]


def vocabulary_map(vocab: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in vocab.items() for x in (k, v)])


def character_ids(df: DataFrame, vocab: dict[str, int], length: int = 128, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """``row_id, ids, mask`` of a fixed length, with a broadcast vocabulary of any size."""
    own = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        for f in batches:
            ids = [ids_of(t, own.value, length) for t in f["text"]]
            pad = [[0] * (length - len(i)) for i in ids]
            yield pd.DataFrame({"row_id": f["row_id"].to_numpy(), "ids": [i + p for i, p in zip(ids, pad)], "mask": [[1] * len(i) + p for i, p in zip(ids, pad)]})

    return df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, "row_id long, ids array<int>, mask array<int>")


def encoded(df: DataFrame, weights: dict[str, np.ndarray], c: EncoderConfig, vocab: Column | dict[str, int], pooled: bool = False, text: str = "text", row_id: str = "row_id", batch: int = 32) -> DataFrame:
    """``row_id, x``: the first place's hidden state, or the pooled one.

    Equal texts meet in one partition, next to each other and to texts of their
    length, so that each is computed once there and few places are padding.
    """
    sc = df.sparkSession.sparkContext
    own, known = sc.broadcast(weights), sc.broadcast(vocab) if isinstance(vocab, dict) else None
    parts = max(df.rdd.getNumPartitions(), WAVES * sc.defaultParallelism)
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    rows = rows.repartition(parts, "text").sortWithinPartitions(F.length("text"), "text")
    if known is None:
        rows = rows.select("row_id", encode_characters(F.col("text"), vocab, c.length).alias("e")).select("row_id", F.slice("e.ids", 1, F.greatest(F.lit(1), F.aggregate("e.mask", F.lit(0), lambda a, b: a + b))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, vector = None, None
        for b in batches:
            values = b.column(1).to_pylist()
            if not values:
                continue
            # ``at``: the place of each row's vector among those of the distinct texts; 0 is the last batch's last one.
            new = np.array([i == 0 and vector is None or v != (values[i - 1] if i else last) for i, v in enumerate(values)])
            at, last = np.cumsum(new), values[-1]
            found = [np.zeros((1, c.width), np.float32) if vector is None else vector]
            ids = [values[i] if known is None else ids_of(values[i], known.value, c.length) for i in np.flatnonzero(new)]
            for i in range(0, len(ids), batch):
                part = ids[i : i + batch]
                size = np.array([len(v) for v in part])
                mask = np.arange(size.max()) < size[:, None]
                places = np.zeros(mask.shape, np.int64)
                places[mask] = np.concatenate(part)
                hidden, pool = forward(places, mask, own.value, c, first=True)
                found.append(pool if pooled else hidden[:, 0])
            x = np.concatenate(found)
            vector = x[at[-1]][None]
            for i in range(0, len(at), OUT_ROWS):
                some = x[at[i : i + OUT_ROWS]].astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * c.width), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(some)), lists], ["row_id", "x"])

    return rows.mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, x array<double>")
