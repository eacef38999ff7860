"""A full-text index over one shard of text: suffix sorting, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Order of all suffixes of positive symbols, by prefix doubling.

    The first key holds as many symbols as fit 62 bits; later rounds sort only
    suffixes that are still tied, so long repeats cost what they hold.
    """
    n = len(sym)
    bits = max(1, int(sym.max()).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= bits
        if i < n:
            key[: n - i] |= sym[i:]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    tied = ~(new & np.r_[new[1:], True])
    while tied.any():
        at = np.flatnonzero(tied)
        who = sa[at]
        after = who + h
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        own = rank[who]
        order = np.lexsort((nxt, own))
        who, own, nxt = who[order], own[order], nxt[order]
        sa[at] = who
        new = np.r_[True, (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[who] = np.maximum.accumulate(np.where(new, at, 0))
        tied[at] = ~(new & np.r_[new[1:], True])
        h *= 2
    return sa


class Wavelet:
    """Wavelet matrix of a symbol sequence: rank and access, many places at once."""

    def __init__(self, sym: np.ndarray):
        self.n = len(sym)
        self.levels = max(1, int(sym.max()).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        pad = -self.n % 64
        for level in reversed(range(self.levels)):
            bit = (sym >> level & 1).astype(np.uint8)
            words = np.packbits(np.r_[bit, np.zeros(pad + 64, np.uint8)], bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(self.n - bit.sum(dtype=np.int64)))
            sym = np.concatenate([sym[bit == 0], sym[bit == 1]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & low)

    def rank(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, plus where its run starts."""
        for k, level in enumerate(reversed(range(self.levels))):
            one = (sym >> level & 1).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its place in the symbol's run."""
        sym = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
            sym = sym << 1 | one
        return sym, at


class Index:
    """FM-index of texts; positions count through the texts, each ended by a separator."""

    STEP = 8

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.r_[0, np.cumsum(size + 1)]
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, sym = np.unique(code, return_inverse=True)
        sym = np.r_[sym.astype(np.int64) + 1, 0]  # 0: the end, smaller than any
        sa = suffix_array(sym)
        last = sym[sa - 1]
        self.wavelet = Wavelet(last)
        # Where a symbol's run starts in the last level, so that rank gives counts.
        every = np.arange(len(self.alphabet) + 2)
        self.base = self.wavelet.rank(every, np.zeros(len(every), np.int64))
        self.first = np.r_[0, np.cumsum(np.bincount(sym, minlength=len(every)))][: len(every)]
        self.n = len(sym)
        sampled = sa % self.STEP == 0
        self.sampled = Wavelet(sampled.astype(np.int64))
        self.positions = sa[sampled]

    def _back(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[sym] + self.wavelet.rank(sym, at) - self.base[sym]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of code points, one phrase each: phrase numbers and positions of all occurrences."""
        at = np.searchsorted(self.alphabet, phrases)
        at = np.minimum(at, len(self.alphabet) - 1)
        live = np.flatnonzero((self.alphabet[at] == phrases).all(axis=1))
        sym = at + 1
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = sym[live, j]
            lo, hi = self._back(c, lo), self._back(c, hi)
            ok = lo < hi
            live, lo, hi = live[ok], lo[ok], hi[ok]
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(live, n), self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Walks back from each row to a sampled one."""
        out = np.empty(len(row), np.int64)
        who, steps = np.arange(len(row)), 0
        while len(who):
            known, _ = self.sampled.access(row)
            hit = known == 1
            at = self.sampled._ones(0, row[hit])
            out[who[hit]] = self.positions[at] + steps
            who, row = who[~hit], row[~hit]
            if len(who):
                sym, place = self.wavelet.access(row)
                row = self.first[sym] + place - self.base[sym]
                steps += 1
        return out
