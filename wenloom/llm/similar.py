"""Most similar vectors for every vector (problem 4): bounds first, cosines where they leave a doubt.

A usable vector has DIMENSION finite numbers, not all zero; all others are left
out. Vectors are scaled to length one and grouped into cells around centroids of a
bounded sample (SAMPLE_ROWS); parts of a cell hold about PART_ROWS (``alike``) or
MEMBER_ROWS and QUERY_ROWS (``nearest``) vectors, by each cell's own share of the
sample, so that a cell of many equal or close vectors is many tasks. Pairs leave a
task in chunks.

* ``alike``: all pairs with at least a given cosine, none missed. Each vector is
  written once, to the file of its part in the shared folder; a task reads the
  parts that it compares from there, so the disk taken doesn't grow with the number
  of comparisons. Of two parts of different cells only vectors meet whose common
  border is no farther than the angle of that cosine. Vectors are turned to the
  sample's principal axes; the inner product over the first FIRST of them plus the
  product of what is left of both lengths bounds the cosine from above, and only
  pairs whose bound reaches it are computed, last in 64 bits. ``exact=True``
  takes whole inner products instead of the bound.
* ``nearest``: the k most similar of each vector. Every vector visits its
  ``probes`` nearest cells; None visits all cells. ``exact=True`` compares every
  member of the visited cells by cosine, else by codes: the signs of a vector turned
  by a fixed random rotation of WIDE dimensions, with its inner product with its own
  code as correction scalar f. The query is rounded to PLANES bits a dimension, one
  packed word row per bit; <code, q> / f estimates <o, q>, with an error of
  sqrt(1 - <o, q>^2) * sqrt(1 - f^2) / f / sqrt(WIDE - 1) times a standard normal
  number, of which REACH are allowed; what is left is reranked by the exact cosine.

Defined cases: null, empty, short, long, all-zero vectors and such with NaN or
infinity are no cases; equal vectors are partners with cosine one; ties are
broken by id; of an id that repeats in a family each vector is compared, but
never with another of the same id; an empty table gives an empty result; rows
without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wenloom.sources.tables import cut_by

DIMENSION = 100
WIDE = 128
PLANES = 4
REACH = 2.0
MISS = 1e-7
FIRST = 31
PROBES = 64
CELL_ROWS = 32_768
PART_ROWS = 16_384
MEMBER_ROWS = 32_768
QUERY_ROWS = 8_192
SAMPLE_ROWS = 20_000
PAIRS = 1_000_000
#: Vectors of a block of the product, and pairs of parts of one task where there are more than tasks for all cores.
TILE = (256, 1_024)
TASK_PAIRS = 8


@lru_cache(maxsize=2)
def rotation(seed: int = 42) -> np.ndarray:
    """DIMENSION orthonormal rows of WIDE numbers."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((WIDE, WIDE)))
    return np.ascontiguousarray(q[:DIMENSION], dtype=np.float32)


def usable(df: DataFrame, vector: str = "vector") -> DataFrame:
    """The rows with a usable vector; JVM-side."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == DIMENSION)).where(fine & F.exists(v, lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, correction scalars and rotated vectors of unit vectors."""
    r = x @ rotation()
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / np.sqrt(WIDE), r


def error(f: np.ndarray) -> np.ndarray:
    """Standard deviation of the estimate for an orthogonal query."""
    return np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(WIDE - 1)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = ~total.any(axis=1)
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return c


@lru_cache(maxsize=8)
def most_bits(cosine: float) -> int:
    """Bits in which all but MISS of the pairs at this cosine differ at most: the binomial tail."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    if p == 0:
        return 0
    if p >= 1:
        return WIDE
    term, left, k = (1 - p) ** WIDE, 1.0, 0
    while k < WIDE:
        left -= term
        if left <= MISS:
            break
        term *= (WIDE - k) / (k + 1) * p / (1 - p)
        k += 1
    return k


def _visits(x: np.ndarray, c: np.ndarray, cosine: float | None, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which cells it visits."""
    near = x @ c.T
    home = np.argmax(near, axis=1)
    if cosine is None:
        if probes is None or probes >= len(c):
            return home, np.ones(near.shape, bool)
        return home, near >= np.partition(near, -probes, axis=1)[:, -probes, None]
    if cosine <= 0:
        visit = np.ones(near.shape, bool)
    else:
        # margin / apart is the sine of the angle to the border: a partner beyond it is at that angle at least.
        square = (c.astype(np.float64) ** 2).sum(axis=1)
        apart = np.sqrt(np.maximum(0, square[:, None] + square - 2 * c.astype(np.float64) @ c.T)).astype(np.float32)
        visit = near[np.arange(len(x)), home][:, None] - near <= np.float32(np.sqrt(max(0, 1 - cosine**2))) * apart[home] + np.float32(1e-4)
    # Pairs across cells are met by the side with the lower cell.
    visit &= np.arange(len(c)) > home[:, None]
    visit[np.arange(len(x)), home] = True
    return home, visit


class Cells:
    """Centroids and axes of each family, and the parts of each cell; one row per family and a bounded sample reach the driver."""

    def __init__(self, vectors: DataFrame, cell_rows: int, probes: int | None):
        self.axes: dict[str, np.ndarray] = {}
        self.centers: dict[str, np.ndarray] = {}
        self.members: dict[str, np.ndarray] = {}
        self.visitors: dict[str, np.ndarray] = {}
        for family, n in sorted((r[0], r[1]) for r in vectors.groupBy("family").count().collect()):
            own = vectors.where(F.col("family") == family)
            rows = own.sample(min(1.0, 1.2 * SAMPLE_ROWS / n), seed=3).select("vector").limit(SAMPLE_ROWS).toArrow()
            k = -(-n // cell_rows)
            x = _unit(rows.column(0).combine_chunks().flatten().to_numpy().reshape(-1, DIMENSION)) if rows.num_rows else np.zeros((0, DIMENSION), np.float32)
            c = centroids(x, k) if k > 1 and len(x) else np.zeros((1, DIMENSION), np.float32)
            home, visit = _visits(x, c, None, probes)
            scale = n / max(1, len(x))
            self.axes[family] = np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, ::-1].astype(np.float32)
            self.centers[family] = c
            self.members[family] = np.bincount(home, minlength=len(c)) * scale
            self.visitors[family] = visit.sum(axis=0) * scale

    def tasks(self, rows: int, queries: int) -> int:
        """How many combinations of parts there are."""
        return sum(int((m * q).sum()) for m, q in (self.parts(family, rows, queries) for family in self.centers))

    def parts(self, family: str, rows: int, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of members and of visitors of each cell."""
        up = lambda n, most: np.maximum(1, np.ceil(1.1 * n / most)).astype(np.int64)
        return up(self.members[family], rows), up(self.visitors[family], queries)


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mix = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mix % parts.astype(np.uint64)).astype(np.int64)


_TASK = ("family", "cell", "mpart", "qpart")


def _spread(bundles: DataFrame, tasks: int) -> DataFrame:
    """Tasks of much work and few bytes, so each mostly gets its own partition instead of being merged by size."""
    return bundles.repartition(max(1, min(20_000, 3 * tasks)), *_TASK)


#: A bundle of vectors for one task: ``role`` 0 members, 2 visitors.
_BUNDLE = "family string, cell int, mpart int, qpart int, role int, ids binary, data binary"


def _bundles(where: dict[tuple, list[np.ndarray]], family: str, ids: np.ndarray, data: np.ndarray) -> pd.DataFrame:
    rows = [(family, cell, m, q, role, ids[at].tobytes(), data[at].tobytes()) for (cell, m, q, role), own in where.items() for at in (np.concatenate(own),)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _BUNDLE.split(", ")])


def _grouped(*keys: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Places of the rows of each combination of keys."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys[::-1])
    own = np.stack([k[order] for k in keys])
    first = np.flatnonzero(np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)])
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield tuple(own[:, a].tolist()), order[a:b]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for b in batches:
        for family, own in b.groupby("family", sort=False):
            yield family, own["row_id"].to_numpy().astype(np.int64), np.stack(own["vector"].to_numpy()).astype(np.float32)


class Blocks:
    """Numbers of the parts of all families' cells, and of the pairs of parts of one family."""

    def __init__(self, cells: Cells):
        self.families = list(cells.centers)
        self.cells = cells
        self.parts = {family: cells.parts(family, PART_ROWS, PART_ROWS)[0] for family in self.families}
        self.count = [int(self.parts[family].sum()) for family in self.families]
        self.first = dict(zip(self.families, np.cumsum([0, *self.count]).tolist()))
        #: Pairs before each family's.
        self.before = np.cumsum([0, *(n * (n + 1) // 2 for n in self.count)]).tolist()

    def of(self, family: str, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = self.parts[family]
        home = np.argmax(x @ self.cells.centers[family].T, axis=1)
        return self.first[family] + (np.cumsum(parts) - parts)[home] + _part(ids, parts[home])

    def pair(self, at: int) -> tuple[str, int, int]:
        """The family and blocks of a pair; those of one first block follow each other."""
        k = int(np.searchsorted(self.before, at, "right")) - 1
        n, rest = self.count[k], at - self.before[k]
        starts = np.cumsum(np.r_[0, np.arange(n, 1, -1)])
        i = int(np.searchsorted(starts, rest, "right")) - 1
        first = self.first[self.families[k]]
        return self.families[k], first + i, first + i + rest - int(starts[i])

    def cell(self, family: str, block: int) -> int:
        return int(np.searchsorted(np.cumsum(self.parts[family]), block - self.first[family], "right"))


def _homes(blocks: Blocks):
    """Each vector in the bundle of its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for family, ids, raw in _batches(batches):
            rows = [(block, ids[at].tobytes(), raw[at].tobytes()) for (block,), at in _grouped(blocks.of(family, ids, _unit(raw)))]
            yield pd.DataFrame(rows, columns=["block", "ids", "data"])

    return run


class Block:
    """One part's vectors, read from the shared folder."""

    def __init__(self, folder: str, block: int, axes: np.ndarray, exact: bool):
        system, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
        self.ids, self.raw = np.zeros(0, np.int64), np.zeros((0, DIMENSION), np.float32)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
            read = pd.concat([pq.ParquetFile(f, filesystem=system).read(["ids", "data"]).to_pandas() for f in files])
            self.ids, self.raw = _joined(read, DIMENSION, np.float32)
        self.length = np.sqrt(_dot(self.raw, self.raw))
        self.unit = _unit(self.raw)
        self.bound = self.unit if exact else bound(self.unit, axes)

    def near_border(self, centers: np.ndarray, own: int, other: int, cosine: float) -> np.ndarray:
        """Places of the vectors that may have a partner in the other cell."""
        if own == other:
            return np.arange(len(self.ids))
        return np.flatnonzero(_visits(self.unit, centers[[own, other]], cosine, None)[1][:, 1])


def bound(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows whose inner products are at least those of ``x``: the first axes, and the length of the rest."""
    turned = x @ axes
    return np.concatenate([turned[:, :FIRST], np.linalg.norm(turned[:, FIRST:], axis=1, keepdims=True)], axis=1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in 64 bits, summed from the first dimension to the last."""
    total = np.zeros(len(a))
    for i in range(DIMENSION):
        total += a[:, i].astype(np.float64) * b[:, i]
    return total


def _joined(b: pd.DataFrame, width: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(b["ids"]), np.int64)
    return ids, np.frombuffer(b"".join(b["data"]), kind).reshape(len(ids), width)


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True)


def _met(a: Block, b: Block, mine: np.ndarray, theirs: np.ndarray, cosine: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both blocks of the pairs whose 32-bit cosine reaches the wanted one; within a block each pair once."""
    rows, columns = TILE
    least = np.float32(cosine - (1e-5 if exact else 1e-4))
    product, reached = np.empty(TILE, np.float32), np.empty(TILE, bool)
    tall = a.bound[mine]
    for j in range(0, len(theirs), columns):
        wide = np.ascontiguousarray(b.bound[theirs[j : j + columns]].T)
        n = wide.shape[1]
        for i in range(0, min(len(mine), j + columns) if a is b else len(mine), rows):
            m = min(rows, len(mine) - i)
            # Whole tiles are computed in the same memory.
            full = (m, n) == TILE
            g = np.matmul(tall[i : i + m], wide, out=product if full else None)
            ok = np.greater_equal(g, least, out=reached if full else None)
            # Eight flags at once, as hardly any is set.
            if full:
                eight = np.flatnonzero(ok.reshape(-1).view(np.uint64))
                at = (eight[:, None] * 8 + np.arange(8)).ravel()
                at = at[ok.reshape(-1)[at]]
            else:
                at = np.flatnonzero(ok)
            if len(at):
                p, q = np.divmod(at, n)
                for s in range(0, len(at), 16_384):
                    x, y = mine[p[s : s + 16_384] + i], theirs[q[s : s + 16_384] + j]
                    ok = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= np.float32(cosine - 1e-5)
                    if a is b:
                        ok &= x < y
                    if ok.any():
                        yield x[ok], y[ok]


def _alike(blocks: Blocks, folder: str, cosine: float, exact: bool):
    def pairs(a: Block, b: Block, mine: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for p, q in _met(a, b, mine, theirs, cosine, exact):
            swap = a.ids[p] > b.ids[q]
            low, high = np.where(swap, b.ids[q], a.ids[p]), np.where(swap, a.ids[p], b.ids[q])
            first, second = np.where(swap, b.length[q], a.length[p]), np.where(swap, a.length[p], b.length[q])
            sure = _dot(a.raw[p], b.raw[q]) / first / second
            ok = (low != high) & (sure >= cosine)
            yield low[ok], high[ok], sure[ok]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, a = -1, None
        for at in (n for b in batches for n in b["id"].tolist()):
            family, i, j = blocks.pair(at)
            axes, centers = blocks.cells.axes[family], blocks.cells.centers[family]
            if i != last:
                last, a = i, Block(folder, i, axes, exact)
            b = a if i == j else Block(folder, j, axes, exact)
            own, other = blocks.cell(family, i), blocks.cell(family, j)
            mine, theirs = a.near_border(centers, own, other, cosine), b.near_border(centers, other, own, cosine)
            found, held = [], 0
            for met in pairs(a, b, mine, theirs):
                found.append(met)
                held += len(met[0])
                if held >= PAIRS:
                    yield pd.DataFrame({"family": family} | {k: np.concatenate(v) for k, v in zip(_PAIR[1:], zip(*found))})
                    found, held = [], 0
            if held:
                yield pd.DataFrame({"family": family} | {k: np.concatenate(v) for k, v in zip(_PAIR[1:], zip(*found))})

    return run


_PAIR = ("family", "low_row_id", "high_row_id", "cosine")


def _route_queries(cells: Cells, probes: int | None):
    """Each member once per part of its cell's visitors, each query once per part of the members of each visited cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for family, ids, raw in _batches(batches):
            x = _unit(raw)
            home, visit = _visits(x, cells.centers[family], None, probes)
            parts, guests = cells.parts(family, MEMBER_ROWS, QUERY_ROWS)
            where: dict[tuple, list[np.ndarray]] = {}
            for (cell, m), at in _grouped(home, _part(ids, parts[home])):
                for q in range(int(guests[cell])):
                    where.setdefault((cell, m, q, 0), []).append(at)
            who, cell = np.nonzero(visit)
            for (c, q), at in _grouped(cell, _part(ids[who], guests[cell])):
                for m in range(int(parts[c])):
                    where.setdefault((c, m, q, 2), []).append(who[at])
            yield _bundles(where, family, ids, x)

    return run


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words."""
    return np.ascontiguousarray(packed).view(np.uint64)


class Estimate:
    """<o, q> of coded members and queries, from packed bits and the members' correction scalars."""

    def __init__(self, x: np.ndarray):
        packed, self.f, _ = encode(x)
        self.code = _words(packed).T.copy()
        self.ones = np.bitwise_count(self.code).sum(axis=0, dtype=np.float32)
        self.off = (REACH * error(self.f)).astype(np.float32)

    def of(self, q: np.ndarray) -> np.ndarray:
        r = q @ rotation()
        low = r.min(axis=1, keepdims=True)
        step = np.maximum((r.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
        u = np.rint((r - low) / step).astype(np.uint8)
        total = np.zeros((len(q), self.code.shape[1]), np.uint16)
        for j in range(PLANES):
            plane = _words(np.packbits(u >> j & 1, axis=1))
            met = np.bitwise_count(plane[:, :1] & self.code[0])
            met += np.bitwise_count(plane[:, 1:] & self.code[1])
            total += met.astype(np.uint16) << np.uint16(j)
        # Signs are 2 * bit - 1; dimensions hold low + step * u.
        flat = low * WIDE + step * u.sum(axis=1, keepdims=True, dtype=np.float32)
        return (2 * (low * self.ones + step * total) - flat) / (np.float32(np.sqrt(WIDE)) * self.f)


def _best(a: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each query number, ties by the smaller id."""
    order = np.lexsort((tie, -value, a))
    own = a[order]
    start = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))
    return order[rank < k]


def _nearest(k: int, exact: bool):
    def cosines(q: np.ndarray, x: np.ndarray, a: np.ndarray, o: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.float32)
        for s in range(0, len(a), 65_536):
            out[s : s + 65_536] = np.einsum("ij,ij->i", q[a[s : s + 65_536]], x[o[s : s + 65_536]])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _whole(batches)
        role, family = b["role"].to_numpy(), b["family"].iloc[0]
        ids, x = _joined(b[role == 0], DIMENSION, np.float32)
        qid, y = _joined(b[role > 0], DIMENSION, np.float32)
        if not len(ids):
            return
        bits = None if exact else Estimate(x)
        sample = np.linspace(0, len(ids) - 1, min(len(ids), 2_048)).astype(np.int64)
        # A quantile of the sample beyond which about 16 k members lie.
        rank = min(len(sample), max(k, -(-16 * k * len(sample) // len(ids))))
        step = max(1, 262_144 // len(ids))
        for i in range(0, len(qid), step):
            q, own = y[i : i + step], qid[i : i + step]
            guess = q @ x.T if exact else bits.of(q)
            guess[own[:, None] == ids] = -2
            some = -np.partition(-guess[:, sample], rank - 1, axis=1)[:, rank - 1]
            a, o = np.nonzero(guess >= np.maximum(some, -1.5)[:, None])
            sure = guess[a, o] if exact else cosines(q, x, a, o)
            if not exact:
                # The k-th best of these by exact cosine bounds what the others must reach.
                best = _best(a, sure, ids[o], k)
                last = np.full(len(q), 3, np.float32)
                np.minimum.at(last, a[best], sure[best])
                last[np.bincount(a[best], minlength=len(q)) < k] = -3
                a, o = np.divmod(np.flatnonzero((guess + bits.off >= last[:, None]) & (guess > -1.5)), len(ids))
                sure = cosines(q, x, a, o)
                ok = sure >= last[a] - np.float32(1e-6)
                a, o, sure = a[ok], o[ok], sure[ok]
            best = _best(a, sure, ids[o], k)
            yield pd.DataFrame({"family": family, "row_id": own[a[best]], "other": ids[o[best]], "cosine": sure[best].astype(np.float64)})

    return run


def prepared(df: DataFrame, family: str, row_id: str, vector: str) -> DataFrame:
    """``family, row_id, vector`` of the usable vectors."""
    rows = df.select(F.lit(family).alias("family"), F.col(row_id).cast("long").alias("row_id"), F.col(vector).cast("array<float>").alias("vector"))
    return usable(rows.where("row_id is not null"))


def _by_task(f):
    """Type hints tell Spark that groups come and go in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(batches)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def alike(vectors: DataFrame, cosine: float, cell_rows: int = CELL_ROWS, exact: bool = False) -> DataFrame:
    """``family, low_row_id, high_row_id, cosine``: all pairs with at least this cosine."""
    spark = vectors.sparkSession
    blocks = Blocks(Cells(vectors, cell_rows, 1))
    rows = vectors.mapInPandas(_homes(blocks), "block int, ids binary, data binary")
    folder = cut_by(rows.repartition(max(1, min(20_000, sum(blocks.count))), "block"), "block")
    total = blocks.before[-1]
    tasks = max(1, -(-total // TASK_PAIRS), min(total, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, total, 1, tasks).mapInPandas(_alike(blocks, folder, cosine, exact), "family string, low_row_id long, high_row_id long, cosine double")


def nearest(vectors: DataFrame, k: int = 10, probes: int | None = PROBES, cell_rows: int = CELL_ROWS, exact: bool = False) -> DataFrame:
    """``family, row_id, rank, other_row_id, cosine``: the k most similar vectors of every vector."""
    cells = Cells(vectors, cell_rows, probes)
    tasks = _spread(vectors.mapInPandas(_route_queries(cells, probes), _BUNDLE), cells.tasks(MEMBER_ROWS, QUERY_ROWS))
    found = tasks.groupBy(*_TASK).applyInPandas(_by_task(_nearest(k, exact)), "family string, row_id long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("family", "row_id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("family", "row_id", "rank", F.col("other").alias("other_row_id"), "cosine")
