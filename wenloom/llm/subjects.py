"""Subjects of each document (problem 10): term weights, truncated SVD, seeded centroids.

1. A document is cut into statements (sentences); a statement's terms are the
   pairs of neighbouring ideographs and the words of other scripts, both in the
   one form of ``looks``.
2. Labelled headlines and labelled documents give counts of term and class. A
   term weighs its inverse document frequency times how far its classes are
   from the classes' overall shares (relative entropy), so that words of every
   class weigh nothing. Every term of at least LEAST_COUNT and LEAST_GAIN is in the
   vocabulary, however many there are.
3. The matrix of statements and terms is reduced by a truncated SVD: subspace
   iterations over all statements. The matrix of terms by RANK is a file that
   the executors map to memory (``Matrix``); its sums are kept for the terms
   that a task meets, SUM_BLOCKS blocks at a time.
4. The seeds are the classes' term counts in that space, one centroid for
   statements in ideographs and one for others; ROUNDS passes over all
   statements assign each by cosine and move the centroids.
5. A statement too light in weighted terms, or far from every centroid, is on no
   class. A document's subjects are the classes of at least SHARE of its
   statements on any class.

Defined cases: null, empty and blank documents, and those without a statement on
a class, have no subject; wrong or null labels are only noise among the seeds;
statements and documents of any length count whole; without any label nothing
is assigned; of a document id that repeats all statements count together.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.llm import looks
from wenloom.sources.tables import cut, release

CLASSES = 10
RANK = 96
ROUNDS = 3
SHARE = 0.25
LEAST_COUNT = 4
SMOOTH = 4.0
LEAST_GAIN = 0.4
LEAST_WEIGHT = 0.6
LEAST_COSINE = 0.15

_WORD = re.compile(r"[^\W\d_㐀-䶿一-鿿]{2,}")
_BREAKS = np.array([ord(c) for c in "。！？!?\n\r"], np.uint32)


@dataclass
class Cut:
    """The statements of a batch of texts, cut with whole arrays.

    ``pair`` holds each distinct pair of neighbouring ideographs of a statement
    as statement << 32 | first << 16 | second; ``words`` the other terms.
    """

    text: np.ndarray  # of each statement
    pair: np.ndarray
    word_at: np.ndarray  # statement of each word
    words: list[str]

    @property
    def ideographic(self) -> np.ndarray:
        n = len(self.text)
        return np.bincount(self.pair >> 32, minlength=n) > np.bincount(self.word_at, minlength=n)


def cut_texts(texts: list[str | None]) -> Cut:
    plain = [looks.skeleton(t).casefold() if t else "" for t in texts]
    joined = "\n".join([*plain, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    end = np.isin(code, _BREAKS)
    dot = np.flatnonzero(code[:-1] == ord("."))
    end[[i for i in dot.tolist() if joined[i + 1].isspace()]] = True
    statement = np.cumsum(end)
    text = np.zeros(int(statement[-1]) + 1 if len(code) else 1, np.int64)
    text[statement] = np.repeat(np.arange(len(plain)), size)
    han = (code >= 0x3400) & (code <= 0x4DBF) | (code >= 0x4E00) & (code <= 0x9FFF)
    at = np.flatnonzero(han[:-1] & han[1:])
    # Sorting beats the hashing of np.unique by far.
    pair = np.sort(statement[at] << 32 | code[at].astype(np.int64) << 16 | code[at + 1])
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    seen: dict[tuple[int, str], None] = {}
    for m in _WORD.finditer(joined):
        seen[int(statement[m.start()]), m[0]] = None
    return Cut(text, pair, np.fromiter((k for k, _ in seen), np.int64, len(seen)), [w for _, w in seen])


_COUNTS = [f"n{k}" for k in range(CLASSES)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of labelled texts with their counts by class, added up per batch before they are shuffled."""
    for b in batches:
        labels = b.column("labels").to_pylist()
        c = cut_texts(b.column("text").to_pylist())
        number = {w: i for i, w in enumerate(dict.fromkeys(c.words))}
        word = np.fromiter((number[w] for w in c.words), np.int64, len(c.words))
        pair, back = np.unique(c.pair & 0xFFFFFFFF, return_inverse=True)
        term, statement = np.concatenate([back, word + len(pair)]), np.concatenate([c.pair >> 32, c.word_at])
        n = np.zeros((CLASSES, len(pair) + len(number)), np.int64)
        for k in range(CLASSES):
            own = np.fromiter((k in x for x in labels), bool, len(labels))[c.text]
            n[k] = np.bincount(term[own[statement]], minlength=n.shape[1])
        some = n.any(axis=0)
        names = [chr(x >> 16) + chr(x & 0xFFFF) for x in pair.tolist()] + list(number)
        terms = [w for w, on in zip(names, some.tolist()) if on]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array(x[some]) for x in n]], ["term", *_COUNTS])


def term_counts(headlines: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``term, n0 ...``: for each term its counts by class, from all labelled rows."""
    fine = F.col("label_id").between(0, CLASSES - 1)
    one = headlines.where(fine).select("text", F.array("label_id").alias("labels"))
    own = labels.where(fine).groupBy("doc_id").agg(F.collect_set("label_id").alias("labels"))
    rows = one.unionByName(docs.join(own, "doc_id").select("text", "labels"))
    counted = rows.mapInArrow(_counted, "term string, " + ", ".join(f"{n} long" for n in _COUNTS))
    return counted.groupBy("term").agg(*[F.sum(n).alias(n) for n in _COUNTS]).where(" + ".join(_COUNTS) + f" >= {LEAST_COUNT}")


class Vocabulary:
    """All telling terms with their weights and class counts."""

    def __init__(self, names: list[str], n: np.ndarray, weight: np.ndarray):
        self.names, self.n, self.weight = names, n.astype(np.float32), weight.astype(np.float32)
        self.han = np.array(["㐀" <= t[0] <= "鿿" for t in names], bool)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Weights are worked out over all terms; every term of LEAST_GAIN is kept."""
    columns = [F.col(f"n{k}").cast("double") for k in range(CLASSES)]
    total = counts.agg(*[F.sum(c) for c in columns]).first()
    prior = np.array([float(x or 0) for x in total]) + 1e-9
    share = prior / prior.sum()
    everything = F.lit(0.0)
    for c in columns:
        everything = everything + c
    gain = F.lit(0.0)
    for c, q in zip(columns, share):
        p = (c + F.lit(SMOOTH * float(q))) / (everything + F.lit(SMOOTH))
        gain = gain + p * F.log(p / F.lit(float(q)))
    rows = counts.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).orderBy("term").toArrow()
    n = np.stack([rows[f"n{k}"].to_numpy().astype(np.float32) for k in range(CLASSES)], axis=1)
    idf = np.log(prior.sum() / np.maximum(n.sum(axis=1, dtype=np.float64), 1)) / np.log(max(prior.sum(), 2))
    return Vocabulary(rows["term"].to_pylist(), n, rows["gain"].to_numpy() * idf)


def _encoder(v: Vocabulary):
    number = np.flatnonzero(v.han)
    keys = np.array([ord(v.names[i][0]) << 16 | ord(v.names[i][1]) for i in number.tolist()], np.int64)
    order = np.argsort(keys)
    keys, number = keys[order], number[order]
    words = {v.names[i]: i for i in np.flatnonzero(~v.han).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = cut_texts(b.column("text").to_pylist())
            hits = [(s << 32) | words[w] for s, w in zip(c.word_at.tolist(), c.words) if w in words]
            cells = np.array(hits, np.int64)
            if len(keys):
                key = c.pair & 0xFFFFFFFF
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[at] == key
                cells = np.concatenate([cells, (c.pair[known] >> 32 << 32) | number[at[known]]])
            cells.sort()
            statement, first = np.unique(cells >> 32, return_index=True)
            ends = pa.array(np.append(first, len(cells)).astype(np.int32))
            at = pa.ListArray.from_arrays(ends, pa.array((cells & 0xFFFFFFFF).astype(np.int32)))
            doc = b.column("doc_id").take(pa.array(c.text[statement]))
            yield pa.RecordBatch.from_arrays([doc, pa.array(c.ideographic[statement]), at], ["doc_id", "han", "at"])

    return run


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, han, at``: the vocabulary terms of every statement that has any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(_encoder(v), "doc_id long, han boolean, at array<int>")


_ROWS = 4_096
BLOCK = 256  # terms summed in one row of a shuffle
SUM_BLOCKS = 640  # blocks a task sums at once, 96 KB each


@dataclass
class Statements:
    """Statements of a batch: terms one after another, where each statement starts, and its weight."""

    at: np.ndarray
    start: np.ndarray
    size: np.ndarray
    norm: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start)), self.size)


def _pieces(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Statements]]:
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            b = whole.slice(i, _ROWS)
            at = b.column("at").flatten().to_numpy()
            size = np.diff(b.column("at").offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(size) - size
            yield b, Statements(at, start, size, np.maximum(np.sqrt(np.add.reduceat(weight[at] ** 2, start)), 1e-12))


class Matrix:
    """A file of terms by rank that each executor fetches once and maps to memory, so that its size binds no heap."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.name = shape, f"basis-{uuid.uuid4().hex}.npy"
        self.path = os.path.join(tempfile.gettempdir(), self.name)
        np.lib.format.open_memmap(self.path, mode="w+", dtype=np.float32, shape=shape).flush()

    def writable(self) -> np.ndarray:
        return np.load(self.path, mmap_mode="r+")

    def shared(self, spark: SparkSession) -> Matrix:
        spark.sparkContext.addFile(self.path)
        return self

    def open(self) -> np.ndarray:
        return np.load(SparkFiles.get(self.name), mmap_mode="r")

    def done(self) -> None:
        """It stays: an executor that comes later may still fetch it."""

    def orthonormal(self) -> Matrix:
        """Its columns made orthonormal in place, by blocks of rows; those without own direction become zero."""
        x = self.writable()
        gram = np.zeros((self.shape[1], self.shape[1]))
        for i in range(0, len(x), _ROWS):
            part = x[i : i + _ROWS].astype(np.float64)
            gram += part.T @ part
        value, turn = np.linalg.eigh(gram)
        real = value > value.max() * 1e-10
        turn = turn * np.where(real, 1 / np.sqrt(np.where(real, value, 1)), 0)
        for i in range(0, len(x), _ROWS):
            x[i : i + _ROWS] = x[i : i + _ROWS] @ turn
        x.flush()
        return self


def _summed(rows: DataFrame, work, shape: tuple[int, int], weight: np.ndarray) -> np.ndarray:
    """Sum over all partitions of a small matrix; one matrix per group of partitions reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(shape), False
        for b, s in _pieces(batches, weight):
            any_ = True
            total += work(b, s)
        if any_:
            grp = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["grp", "m"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(m, np.float64) for m in b["m"]).tobytes()]})

    parts = rows.mapInArrow(run, "grp int, m binary").groupBy("grp").applyInPandas(add, "m binary").collect()
    return sum((np.frombuffer(m, np.float64).reshape(shape) for (m,) in parts), np.zeros(shape))


GROUPS = 64


def random_signs(at: np.ndarray, rank: int) -> np.ndarray:
    """Rows of a fixed random matrix of -1 and 1, worked out from the terms' numbers."""
    words = -(-rank // 64)
    mix = (at.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ (mix >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mix = (mix ^ (mix >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mix ^= mix >> np.uint64(31)
    out = np.unpackbits(mix.view(np.uint8), axis=1)[:, :rank].astype(np.float32)
    out *= 2
    out -= 1
    return out


def _halved(x: np.ndarray) -> bytes:
    """Rows of numbers for the way to the next task: the largest of each row, and the others by it in half precision."""
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32)
    return np.concatenate([top.view(np.float16), (x / top).astype(np.float16)], axis=1).tobytes()


def _read(m: bytes, rank: int) -> np.ndarray:
    x = np.frombuffer(m, np.float16).reshape(-1, rank + 2)
    return x[:, 2:].astype(np.float32) * np.ascontiguousarray(x[:, :2]).view(np.float32)


def _iterated(rows: DataFrame, v: Vocabulary, basis: Matrix | None, rank: int) -> Matrix:
    """The statements' matrix, transposed, times itself and ``basis`` (None: random signs).

    Of a block of terms only the rows met are moved, and partitions in groups are
    added first, so that no task gathers a block of every partition.
    """

    def flushed(sums: dict[int, np.ndarray], met: dict[int, np.ndarray]) -> pa.RecordBatch:
        own = [(k, np.flatnonzero(met[k]).astype(np.int16).tobytes(), _halved(m[met[k]])) for k, m in sums.items()]
        k, at, m = zip(*own)
        grp = TaskContext.get().partitionId() % GROUPS
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(at, pa.binary()), pa.array(m, pa.binary())], ["grp", "k", "at", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if basis is None else basis.open()
        sums: dict[int, np.ndarray] = {}
        met: dict[int, np.ndarray] = {}
        for _, s in _pieces(batches, v.weight):
            far = random_signs(s.at, rank) if own is None else own[s.at]
            far *= v.weight[s.at, None]
            # Both sides of the product are divided by the statement's norm; the terms' weights come after the sum.
            inner = np.add.reduceat(far, s.start) / (s.norm * s.norm)[:, None].astype(np.float32)
            order = np.argsort(s.at, kind="stable")
            at = s.at[order]
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            np.take(inner, s.row[order], axis=0, out=far)
            at = at[head]
            out = np.add.reduceat(far, head) * v.weight[at, None]
            edge = np.flatnonzero(np.r_[True, at[1:] // BLOCK != at[:-1] // BLOCK, True])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                k = int(at[i]) // BLOCK
                if k not in sums:
                    sums[k], met[k] = np.zeros((BLOCK, rank), np.float32), np.zeros(BLOCK, bool)
                sums[k][at[i:j] % BLOCK] += out[i:j]
                met[k][at[i:j] % BLOCK] = True
            if len(sums) > SUM_BLOCKS:
                yield flushed(sums, met)
                sums, met = {}, {}
        if sums:
            yield flushed(sums, met)

    def add(b: pd.DataFrame) -> pd.DataFrame:
        total, seen = np.zeros((BLOCK, rank)), np.zeros(BLOCK, bool)
        for at, m in zip(b["at"], b["m"]):
            own_at = np.frombuffer(at, np.int16)
            total[own_at] += _read(m, rank)
            seen[own_at] = True
        return pd.DataFrame({"k": [b["k"].iloc[0]], "at": [np.flatnonzero(seen).astype(np.int16).tobytes()], "m": [_halved(total[seen])]})

    parts = rows.mapInArrow(run, "grp int, k int, at binary, m binary")
    if rows.rdd.getNumPartitions() > GROUPS:
        parts = parts.groupBy("grp", "k").applyInPandas(add, "k int, at binary, m binary")
    out = Matrix((len(v.names), rank))
    x = out.writable()
    for k, at, m in parts.groupBy("k").applyInPandas(add, "k int, at binary, m binary").toLocalIterator():
        x[k * BLOCK + np.frombuffer(at, np.int16).astype(np.int64)] = _read(m, rank)
    x.flush()
    return out


def svd_basis(rows: DataFrame, v: Vocabulary, rank: int = RANK, passes: int = 2) -> Matrix:
    """Right singular vectors of the statements' matrix: terms by rank."""
    basis = None
    for _ in range(passes):
        basis = _iterated(rows, v, basis, rank).orthonormal().shared(rows.sparkSession)
    return basis


def measured(rows: DataFrame, v: Vocabulary, basis: Matrix) -> DataFrame:
    """With ``length``: of each statement's image in the space, the norms of the statement and the image multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = basis.open()
        for b, s in _pieces(batches, v.weight):
            far = own[s.at]
            far *= v.weight[s.at, None]
            e = np.add.reduceat(far, s.start)
            length = np.sqrt(np.einsum("ij,ij->i", e, e))
            # Too light a statement is on no class.
            length[s.norm < LEAST_WEIGHT] = np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length.astype(np.float32))], ["doc_id", "han", "at", "length"])

    return rows.mapInArrow(run, "doc_id long, han boolean, at array<int>, length float")


def seeds(v: Vocabulary, basis: Matrix) -> np.ndarray:
    """2 * CLASSES centroids: of statements in other scripts, then of such in ideographs."""
    x = basis.writable()
    return _scaled(np.concatenate([(v.n * (v.weight * own)[:, None]).T @ x for own in (~v.han, v.han)]))


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


SENT_BYTES = 64_000_000


class Sent:
    """A matrix of at most SENT_BYTES as a broadcast that can be taken back."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        self.value = spark.sparkContext.broadcast(x)

    def open(self) -> np.ndarray:
        return self.value.value

    def done(self) -> None:
        self.value.destroy()


def projected(spark: SparkSession, v: Vocabulary, basis: Matrix, centers: np.ndarray) -> Matrix | Sent:
    """What each term adds to the inner products with the centroids: terms by centroids."""
    shape = (len(v.names), len(centers))
    small = 4 * shape[0] * shape[1] <= SENT_BYTES
    out = None if small else Matrix(shape)
    x, y = basis.writable(), np.empty(shape, np.float32) if small else out.writable()
    for i in range(0, len(x), _ROWS):
        y[i : i + _ROWS] = (x[i : i + _ROWS] @ centers.T) * v.weight[i : i + _ROWS, None]
    if small:
        return Sent(spark, y)
    y.flush()
    return out.shared(spark)


def assign(b: pa.RecordBatch, s: Statements, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid (-1: none) of each statement, and the length of its image."""
    length = np.maximum(b.column("length").to_numpy(), 1e-12)
    inner = np.add.reduceat(near[s.at], s.start)
    han = b.column("han").to_numpy(zero_copy_only=False)
    inner[han, :CLASSES] = -np.inf
    inner[~han, CLASSES:] = -np.inf
    best = np.argmax(inner, axis=1)
    with np.errstate(invalid="ignore"):
        cosine = np.where(np.isfinite(length), inner[np.arange(len(best)), best] / length, -1)
    return np.where(cosine >= LEAST_COSINE, best, -1), length


def refine(rows: DataFrame, v: Vocabulary, basis: Matrix, centers: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids moved to the sum of the directions of the statements assigned to them."""
    for _ in range(rounds):
        near = projected(rows.sparkSession, v, basis, centers)

        def work(b: pa.RecordBatch, s: Statements, near: Matrix | Sent = near) -> np.ndarray:
            best, length = assign(b, s, near.open())
            row = s.row
            on = best[row] >= 0
            terms, place = np.unique(s.at[on], return_inverse=True)
            value = v.weight[s.at[on]] / length[row[on]]
            cells = np.bincount(best[row[on]] * len(terms) + place, value, len(centers) * len(terms)).reshape(len(centers), -1)
            return cells @ basis.open()[terms]

        moved = _summed(rows, work, centers.shape, v.weight)
        near.done()
        some = moved.any(axis=1)
        centers = np.where(some[:, None], _scaled(moved), centers)
    return centers


def on_classes(rows: DataFrame, v: Vocabulary, basis: Matrix | None, centers: np.ndarray) -> DataFrame:
    """``doc_id, label_id, statements``: how many statements of each document are on each class."""
    if basis is None:
        return rows.where("false").selectExpr("doc_id", "0 as label_id", "0L as statements")
    near = projected(rows.sparkSession, v, basis, centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s in _pieces(batches, v.weight):
            best, _ = assign(b, s, near.open())
            on = best >= 0
            own = pd.DataFrame({"doc_id": b.column("doc_id").to_numpy()[on], "label_id": (best[on] % CLASSES).astype(np.int32)})
            yield pa.RecordBatch.from_pandas(own.groupby(["doc_id", "label_id"]).size().rename("n").reset_index(), preserve_index=False)

    return rows.mapInArrow(run, "doc_id long, label_id int, n long").groupBy("doc_id", "label_id").agg(F.sum("n").alias("statements"))


def model(headlines: DataFrame, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Vocabulary, Matrix | None, np.ndarray]:
    """Encoded statements, vocabulary, basis and centroids."""
    v = vocabulary(cut(term_counts(headlines, docs, labels)))
    rows = cut(encoded(docs, v))
    if not v.names:
        return rows, v, None, np.zeros((2 * CLASSES, RANK), np.float32)
    basis = svd_basis(rows, v, min(RANK, len(v.names)))
    plain, rows = rows, cut(measured(rows, v, basis))
    release(plain)
    return rows, v, basis, refine(rows, v, basis, seeds(v, basis))


def subjects(counted: DataFrame) -> DataFrame:
    """``doc_id, label_id`` of the classes with at least SHARE of a document's statements."""
    total = counted.groupBy("doc_id").agg(F.sum("statements").alias("total"))
    return counted.join(total, "doc_id").where(F.col("statements") >= SHARE * F.col("total")).select("doc_id", "label_id")


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``label_id, documents, share``: the corpus by subject; a null label: documents without one."""
    all_docs = docs.agg(F.count(F.lit(1)).alias("total"))
    own = docs.select("doc_id").join(found, "doc_id", "left").groupBy("label_id").agg(F.count(F.lit(1)).alias("documents"))
    return own.join(F.broadcast(all_docs)).select("label_id", "documents", (F.col("documents") / F.col("total")).alias("share"))
