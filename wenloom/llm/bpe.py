"""Encoding by a public byte-level tokenizer (problem 8): corpus-level merge replay.

A shard of documents is cut into pieces by the tokenizer's pattern; its
distinct pieces become one array of byte symbols with links to the neighbours.
An inverted index maps each mergeable pair to the positions where it stands.
Merges are then replayed in rank order, each over all its positions at once,
and only the pairs with a touched neighbour are looked up again. A pair that a
merge creates always has a higher rank than the merge, so one pass suffices.

Shards are parts of the scan's own partitions, bounded by their bytes, so
nothing is shuffled and memory doesn't depend on the corpus.

Defined cases: null and empty texts have an empty list of ids; blank texts are
encoded like any other; strings of special tokens are ordinary text; documents
of any length are encoded whole (one above the bound is a shard of its own).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("WENLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that cuts text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 4_000_000


class Vocabulary:
    """Ranks of a tiktoken-style file, and the merge of each pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        left, right, made = [], [], []
        for token, r in self.rank.items():
            if len(token) > 1 and (pair := self._halves(token, r)):
                left.append(pair[0])
                right.append(pair[1])
                made.append(r)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.keys, self.made = key[order], np.array(made, np.int64)[order]
        self.left, self.right = dict(zip(made, left)), dict(zip(made, right))

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two ids whose merge makes the token: what lower ranks leave of it."""
        piece = [token[i : i + 1] for i in range(len(token))]
        while len(piece) > 2:
            best = min(((self.rank.get(piece[i] + piece[i + 1], rank), i) for i in range(len(piece) - 1)))
            if best[0] >= rank:
                return None
            piece[best[1] : best[1] + 2] = [piece[best[1]] + piece[best[1] + 1]]
        return self.rank[piece[0]], self.rank[piece[1]]

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Places of each mergeable pair, given out by rising rank."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.ranks: list[int] = []

    def file(self, rank: np.ndarray, place: np.ndarray) -> None:
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        ends = np.flatnonzero(np.r_[rank[1:] != rank[:-1], True]) + 1
        at = 0
        for r, end in zip(rank[ends - 1].tolist(), ends.tolist()):
            if r not in self.places:
                self.places[r] = []
                heapq.heappush(self.ranks, r)
            self.places[r].append(place[at:end])
            at = end

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        while self.ranks:
            r = heapq.heappop(self.ranks)
            yield r, np.concatenate(self.places.pop(r))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; sorting beats the hashing of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def replay(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and where each piece starts."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = v.byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
    n = len(sym)
    word = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    last = np.cumsum(size) - 1
    after[last] = n  # n: no neighbour
    before[last[:-1] + 1] = -1
    index = PairIndex()
    first = np.flatnonzero(after < n).astype(np.int32)
    rank = v.merges(sym[first].astype(np.int64), sym[first + 1].astype(np.int64))
    index.file(rank[rank >= 0], first[rank >= 0])
    alive = np.ones(n + 1, bool)
    # Ranks only grow, so every id is met at most once.
    for r, place in index:
        a, b = v.left[r], v.right[r]
        place = place[alive[place] & (sym[place] == a)]
        nxt = after[place]
        ok = nxt < n
        place, nxt = place[ok], nxt[ok]
        ok = sym[nxt] == b
        place = _distinct(place[ok])
        if not len(place):
            continue
        nxt = after[place]
        if a == b:
            place = _apart(place, nxt)
            nxt = after[place]
        sym[place] = r
        alive[nxt] = False
        end = after[nxt]
        after[place] = end
        ok = end < n
        before[end[ok]] = place[ok]
        left = before[place]
        ok = left >= 0
        near = np.concatenate([left[ok], place])
        near = _distinct(near[after[near] < n])
        if len(near):
            rank = v.merges(sym[near].astype(np.int64), sym[after[near]].astype(np.int64))
            ok = rank > r
            index.file(rank[ok], near[ok])
    keep = alive[:n]
    count = np.bincount(word[keep], minlength=len(pieces))
    return sym[keep], np.r_[0, np.cumsum(count)]


def _apart(place: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions of a pair of twins, those that a scan from the left merges."""
    chained = np.r_[False, nxt[:-1] == place[1:]]
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(place))))
    return place[(np.arange(len(place)) - start) % 2 == 0]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text of one shard."""
    v = vocabulary(path)
    cut = regex.compile(PATTERN)
    number: dict[str, int] = {}
    words: list[int] = []
    ends = []
    for t in texts:
        words.extend(number.setdefault(w, len(number)) for w in cut.findall(t))
        ends.append(len(words))
    if not number:
        return [np.empty(0, np.int32) for _ in texts]
    ids, start = replay([w.encode("utf-8", "surrogatepass") for w in number], v)
    w = np.array(words, np.int64)
    n = start[w + 1] - start[w]
    total = np.cumsum(n)
    flat = ids[np.repeat(start[w] - (total - n), n) + np.arange(int(total[-1]))]
    bounds = np.r_[0, total][np.r_[0, np.array(ends)]]
    return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def _encoder(file: str):
    def made(ids: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        own = encode(texts, SparkFiles.get(file))
        ends = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
        flat = np.concatenate(own).astype(np.int32) if own else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            at = 0
            for to, t in enumerate(b.column(1).to_pylist(), 1):
                texts.append(t or "")
                held += 3 * len(texts[-1])
                if held >= SHARD_BYTES:
                    ids.append(b.column(0).slice(at, to - at))
                    yield made(ids, texts)
                    ids, texts, held, at = [], [], 0, to
            ids.append(b.column(0).slice(at))
        if texts:
            yield made(ids, texts)

    return run


def encoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens; a null id stays null."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The file is on the driver; executors fetch it once.
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}.tiktoken")
    return rows.mapInArrow(_encoder(f"{name}.tiktoken"), "doc_id long, ids array<int>")
