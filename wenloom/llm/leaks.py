"""Evaluation texts that leaked into documents (problem 9): an FM-index per shard.

Items and documents are compared by their letters only (``looks.letters``). A
sentence that begins at least three items is their shared lead-in and doesn't
count. A document holds an item if one piece of at least half the item's
remaining characters runs through it with at most one altered, missing or
added character in twenty.

Such a piece of L characters has an unaltered stretch of at least
(L - L//20) / (L//20 + 1); phrases of a length and stride that no such stretch
can miss are searched backwards in an FM-index of each shard of documents.
Positions come from sampled suffixes. Diagonals of a pair of item and document
fall into overlapping windows of bounded width, each as wide as the shifts of a
whole piece and more; windows with enough different phrases are aligned, and the
spans of a pair that touch come out merged.

Items are searched in blocks of bounded size. Each block is a file that executors
fetch; an index is built once per shard and searched for all blocks. Documents
aren't shuffled.

Defined cases: null, empty and blank documents hold nothing; items without
letters beyond the lead-in leak nowhere; equal items and repeated documents
are reported each by their own id; a text of any length is indexed whole.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.llm import looks
from wenloom.llm.fmindex import Index

RARE = 20
LEAD_ITEMS = 3
SHARD_CHARS = 800_000
BLOCK_CHARS = 2_000_000
_ENDS = "。！？!?."


def first_sentence(text: str | None) -> int:
    """Where the first sentence ends, 0 if nothing follows it."""
    for i, c in enumerate(text or ""):
        if c in _ENDS:
            return i + 1
    return 0


@F.pandas_udf(T.StructType().add("lead", T.StringType()).add("rest", T.StringType()).add("whole", T.StringType()))
def _wording(text: pd.Series) -> pd.DataFrame:
    end = text.map(first_sentence)
    cut = [(looks.letters(t[:e]), looks.letters(t[e:]), looks.letters(t)) if t else ("", "", "") for t, e in zip(text, end, strict=True)]
    return pd.DataFrame(cut, columns=["lead", "rest", "whole"])


def wordings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, wording``: the letters of each item without a shared lead-in."""
    own = items.select(F.col(item_id).alias("item_id"), _wording(F.col(text)).alias("w")).select("item_id", "w.*")
    shared = own.where("lead <> ''").groupBy("lead").agg(F.count_distinct("rest").alias("n")).where(F.col("n") >= LEAD_ITEMS).select("lead", F.lit(True).alias("cut"))
    return own.join(shared, "lead", "left").select("item_id", F.when(F.col("cut"), F.col("rest")).otherwise(F.col("whole")).alias("wording")).where("wording <> ''")


def plan(n: int) -> tuple[int, int, int]:
    """Phrase length, stride, and phrases at least found for any piece of an item of n characters."""
    sizes = range(-(-n // 2), n + 1)
    whole = min(-(-(m - m // RARE) // (m // RARE + 1)) for m in sizes)
    stride = max(1, whole // 7)
    length = whole - stride + 1
    need = min((m - length + 1) // stride - (m // RARE) * -(-length // stride) for m in sizes)
    return length, stride, max(1, need)


def longest(value: np.ndarray, allow: int = 0) -> tuple[int, int]:
    """Start and length of the longest stretch whose sum is at least ``-allow``."""
    p = np.r_[0, np.cumsum(value)]
    top = np.maximum.accumulate(p[::-1])[::-1]
    low = np.flatnonzero(p < np.r_[np.inf, np.minimum.accumulate(p)[:-1]])
    end = np.searchsorted(-top, allow - p[low], "right") - 1
    k = int(np.argmax(end - low))
    return int(low[k]), int(end[k] - low[k])


WINDOW = 64
_GAP = np.zeros(1, np.uint32)
STEP_ROWS = 256


def straight(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """The first piece of half the item on one diagonal, those with most phrases first."""
    n = len(item)
    own, many = np.unique(diagonals, return_counts=True)
    for d in own[np.argsort(-many, kind="stable")].tolist():
        lo, hi = max(0, -d), min(n, len(doc) - d)
        same = doc[lo + d : hi + d] == item[lo:hi]
        # A piece of half the item has no more alterations than these.
        if 2 * np.count_nonzero(same) < n - n // RARE - 1:
            continue
        a, size = longest(np.where(same, 1, 1 - RARE))
        if 2 * size >= n:
            return lo + a, lo + a + d, size
    return 0, 0, 0


def plausible(item: np.ndarray, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in the joined texts where the item would begin, by a window's least diagonal: whether enough of it is near.

    A piece of L characters leaves at most (3 L + 40) / 20 of them in no run of
    three on any diagonal, see ``align``; that bound is worked out for many windows
    at once, for those no wider than a piece's shifts.
    """
    n, slack = len(item), len(item) // RARE
    out = np.zeros(len(at), bool)
    reach = np.arange(-slack, n + 2 * slack)
    step = max(1, 2_000_000 // len(reach))
    for i in range(0, len(at), step):
        near = texts[np.clip(at[i : i + step, None] + reach, 0, len(texts) - 1)]
        some = np.zeros((len(near), max(0, n - 2)), bool)
        for d in range(3 * slack + 1):
            same = near[:, d : d + n] == item
            some |= same[:, :-2] & same[:, 1:-1] & same[:, 2:]
        covered = np.zeros((len(near), n), bool)
        for k in range(3):
            covered[:, k : n - 2 + k] |= some
        out[i : i + step] = covered.sum(axis=1) >= 0.425 * n - 2
    return out


def _same(item: np.ndarray, doc: np.ndarray, d: np.ndarray, i: int, j: int) -> np.ndarray:
    """Where characters i to j of the item equal the document's on the diagonals."""
    at = np.arange(i, j)[:, None] + d
    return (doc[np.clip(at, 0, len(doc) - 1)] == item[i:j, None]) & (at >= 0) & (at < len(doc))


def _covered(item: np.ndarray, doc: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Characters of the item in a run of three on any of the diagonals."""
    n = len(item)
    out = np.zeros(n, bool)
    for i in range(0, n, STEP_ROWS):
        same = _same(item, doc, d, i, min(n, i + STEP_ROWS + 2))
        some = np.flatnonzero((same[:-2] & same[1:-1] & same[2:]).any(axis=1)) + i
        for k in range(3):
            out[some + k] = True
    return out


def align(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """Start in the item, start in the document and length of the longest shared piece near the diagonals.

    Scores are kept for every STEP_ROWS characters and the rows between are worked
    out again on the way back, so that memory grows with the window's width only.
    """
    n = len(item)
    slack = n // RARE
    found = straight(item, doc, diagonals)
    if found[2] or not slack:
        return found
    d = np.arange(int(diagonals.min()) - slack, int(diagonals.max()) + slack + 1)
    # A piece with e alterations has e + 1 unaltered runs; each either has three
    # characters or loses two, so few of its characters lie in no run of three.
    if 2 * longest(np.where(_covered(item, doc, d), 3, 3 - RARE), 2 * RARE)[1] < n:
        return 0, 0, 0
    slope, width = RARE * np.arange(len(d)), np.arange(len(d))

    def rows(score: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = np.where(_same(item, doc, d, i, j), 1, 1 - RARE)
        source = np.empty((j - i, len(d)), np.int32)
        drop = np.full(len(d), -np.inf)
        for r in range(j - i):
            raised = score + slope
            best = np.maximum.accumulate(raised)
            stay = best - slope + value[r]
            drop[:-1] = score[1:] + (1 - RARE)
            down = drop > stay
            source[r] = np.where(down, width + 1, np.maximum.accumulate(np.where(raised == best, width, 0)))
            score = np.where(down, drop, stay)
        return score, source, value

    starts = list(range(0, n, STEP_ROWS))
    kept = [np.zeros(len(d))]
    for i in starts:
        kept.append(rows(kept[-1], i, min(n, i + STEP_ROWS))[0])
    path, gain, k = np.empty(n, np.int64), np.empty(n), int(np.argmax(kept[-1]))
    for i, score in zip(reversed(starts), reversed(kept[:-1])):
        _, source, value = rows(score, i, min(n, i + STEP_ROWS))
        for r in reversed(range(len(source))):
            path[i + r] = k
            k2 = int(source[r, k])
            gain[i + r] = 1 - RARE if k2 > k else value[r, k] - RARE * (k - k2)
            k = k2
    a, size = longest(gain)
    return a, a + int(d[path[min(a, n - 1)]]), size


class Items:
    """A block of items with their phrases."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for _, w in rows]
        plans = {n: plan(n) for n in {len(c) for c in self.codes}}
        self.need = np.array([plans[len(c)][2] for c in self.codes], np.int64)
        where: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, c in enumerate(self.codes):
            length, stride, _ = plans[len(c)]
            for a in range(0, len(c) - length + 1, stride):
                where[length][c[a : a + length].tobytes()].append((k, a))
        self.phrases = []
        for length, own in sorted(where.items()):
            matrix = np.frombuffer(b"".join(own), np.uint32).reshape(-1, length)
            many = np.fromiter(map(len, own.values()), np.int64, len(own))
            uses = np.array([u for v in own.values() for u in v], np.int64)
            self.phrases.append((matrix, np.cumsum(many) - many, many, uses))


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start in the item, start in the text, length) of one pair, those that touch in the text as one."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(spans, key=lambda s: s[1]):
        if out and j <= out[-1][1] + out[-1][2]:
            a, b, m = out[-1]
            out[-1] = min(a, i), b, max(m, j + n - b)
        else:
            out.append((i, j, n))
    return out


def search(items: Items, index: Index, codes: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Item, text, start in the item, start in the text and length of every leaked passage."""
    hits = []
    for matrix, first, many, uses in items.phrases:
        phrase, position = index.search(matrix)
        if len(phrase):
            n = many[phrase]
            use = uses[np.repeat(first[phrase] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            hits.append(np.c_[use, np.repeat(position, n)])
    if not hits:
        return []
    item, place, position = np.concatenate(hits).T
    doc = np.searchsorted(index.starts, position, "right") - 1
    diagonal = position - index.starts[doc] - place
    # A window begins every ``step`` diagonals and reaches a piece's shifts into the next.
    size = np.array([len(c) for c in items.codes], np.int64)[item]
    slack = size // RARE
    step = 4 * slack + WINDOW
    window = (diagonal + size) // step
    both = np.flatnonzero((diagonal + size) - window * step <= slack)
    item, doc, diagonal, place, window = (np.r_[x, x[both]] for x in (item, doc, diagonal, place, window))
    window[len(window) - len(both) :] -= 1
    order = np.lexsort((place, window, doc, item))
    item, doc, diagonal, place, window = (x[order] for x in (item, doc, diagonal, place, window))
    new = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(item)]
    different = np.add.reduceat(np.r_[True, (place[1:] != place[:-1])] | new, starts, dtype=np.int64)
    enough = different >= items.need[item[starts]]
    low, high = np.minimum.reduceat(diagonal, starts), np.maximum.reduceat(diagonal, starts)
    texts = np.concatenate([x for c in codes for x in (c, _GAP)])
    for k in np.unique(item[starts[enough]]).tolist():
        own = np.flatnonzero(enough & (item[starts] == k))
        own = own[high[own] - low[own] <= len(items.codes[k]) // RARE]
        if len(items.codes[k]) > 2:
            enough[own] = plausible(items.codes[k], texts, index.starts[doc[starts[own]]] + low[own])
    spans: dict[tuple[int, int], list] = defaultdict(list)
    for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
        own = items.codes[item[a]]
        found = align(own, codes[doc[a]], diagonal[a:b])
        if found[2] and 2 * found[2] >= len(own):
            spans[int(item[a]), int(doc[a])].append(found)
    return [(k, t, *s) for (k, t), own in spans.items() for s in merged(own)]


class Blocks:
    """Blocks of items as files that each executor fetches once; a single block is kept open."""

    def __init__(self, spark: SparkSession, blocks: Iterator[Items]):
        self.names = []
        for block in blocks:
            path = os.path.join(tempfile.gettempdir(), f"items-{uuid.uuid4().hex}.pickle")
            with open(path, "wb") as f:
                pickle.dump(block, f)
            spark.sparkContext.addFile(path)
            self.names.append(os.path.basename(path))

    def __iter__(self) -> Iterator[Items]:
        for name in self.names:
            with open(SparkFiles.get(name), "rb") as f:
                yield pickle.load(f)


def _searcher(blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found: list[tuple[int, int, int, int, int]] = []
            if any(texts):
                index = Index(texts)
                codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
                for items in only or blocks:
                    found += [(items.ids[k], *rest) for k, *rest in search(items, index, codes)]
            item, t, i, j, n = np.array(found, np.int64).reshape(-1, 5).T
            docs = pa.concat_arrays(ids).take(pa.array(t))
            cols = [pa.array(item), docs, pa.array(i), pa.array(j), pa.array(n)]
            return pa.RecordBatch.from_arrays(cols, ["item_id", "doc_id", "item_start", "doc_start", "span"])

        only = list(blocks) if len(blocks.names) == 1 else None
        ids: list[pa.Array] = []
        texts: list[str] = []
        held = 0
        for b in batches:
            at = 0
            for to, t in enumerate(b.column(1).to_pylist(), 1):
                texts.append(looks.letters(t))
                held += len(texts[-1]) + 1
                if held >= SHARD_CHARS:
                    ids.append(b.column(0).slice(at, to - at))
                    yield flush()
                    ids, texts, held, at = [], [], 0, to
            ids.append(b.column(0).slice(at))
        if texts:
            yield flush()

    return run


def passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id, doc_id, item_start, doc_start, span``: the leaked passages, in letters."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    worded = wordings(items).withColumn("item_id", F.col("item_id").cast("long")).where("item_id is not null")
    schema = "item_id long, doc_id long, item_start long, doc_start long, span long"
    total = worded.agg(F.sum(F.length("wording"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))

    def made() -> Iterator[Items]:
        # A block at a time is on the driver.
        for k in range(blocks):
            own = worded.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else worded
            yield Items(sorted((r[0], r[1]) for r in own.collect()))

    return rows.mapInArrow(_searcher(Blocks(docs.sparkSession, made())), schema)


def leaked(found: DataFrame) -> DataFrame:
    return found.select("item_id", "doc_id").distinct()
