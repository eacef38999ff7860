"""Same or nearly the same records across splits (problem 1), by suffix arrays.

Texts are compared as in ``copies``: the normalised parts between bars, in any
order. The distance of two texts is the least edit distance over the orders of
their parts; they overlap if it is at most a fifth of the longer one's length,
bars included. Parts are tried in every order where both texts have at most
ORDERED of them; beyond that, in sorted order and by the cheapest assignment of
parts to parts, so that equal parts always meet.

The side with more characters asks, the other offers. An asking text of n
characters has partners of at most 5n / 4, so at most n / 4 edits; with d of them
d + 1 disjoint pieces of it, none over a bar, leave one that occurs unchanged in
the partner.

1. Every distinct offering text gives its suffixes inside the parts. Of an asking
   text's pieces of equal width (at most WIDTH) the rarest are anchors, by counts
   of a bounded sample; which are taken changes the work only.
2. An anchor is dropped if no offered suffix starts with its characters, told by
   a bitmap of BITS bits, which errs only by keeping.
3. The rest is range-partitioned by first characters; boundaries come from the
   same sample. A prefix that holds more than a partition's share is split by the
   asking records, and the offered suffixes of it go to each of its partitions.
4. Each partition sorts its suffixes and takes the common prefixes of
   neighbours. The offered suffixes around an anchor whose common prefix is at
   least a piece form an interval. Pairs whose lengths, places or letter sets
   differ by more than the edits allow are dropped. A text's last anchors meet only
   texts so much longer that they allow as many edits.
5. The pairs are confirmed by the distance, first by the characters they share; their common passages of at least
   WIDTH characters are merged to the characters covered.

Suffixes are moved and ordered by their first WIDTH characters, as many as a piece
has, ``Suffixes`` holds DEPTH. Every pair within the distance is found.

Defined cases: null and blank texts and texts without a letter or digit match
nothing; equal texts are one distinct text and each of their rows comes out;
texts under four characters only match if they are equal; an empty table on
either side gives an empty result; the length of a text is not bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.llm import looks
from wenloom.sources.tables import cut

SHARE = 5
WIDTH = 3
DEPTH = 8
ORDERED = 4
SAMPLE_TEXTS = 4_000
PARTITION_SUFFIXES = 1_000_000
BITS = 1 << 24
CHUNK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BAR = ord("|")


@F.pandas_udf(T.StringType())
def _canon(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "|".join(looks.parts(t)) if looks.has_word(t) else None)


def canonical(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    return df.select(F.col(row_id).alias("row_id"), _canon(F.col(text)).alias("canon")).where(F.col("canon").isNotNull())


# ---- pieces ----------------------------------------------------------------------


@lru_cache(maxsize=65_536)
def pieces(sizes: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Width and places of disjoint pieces of a text with parts of these sizes; at least one more than any partner's edits."""
    n = sum(sizes) + len(sizes) - 1
    need = n // (SHARE - 1) + 1
    width = next((w for w in range(WIDTH, 0, -1) if sum(s // w for s in sizes) >= need), 0)
    if n < SHARE - 1 or not width:
        return 0, ()
    out, at = [], 0
    for s in sizes:
        out += range(at, at + s - width + 1, width)
        at += s + 1
    return width, tuple(out)


class Suffixes:
    """The suffixes of a batch of texts; each begins inside a part and has ``width`` characters there."""

    def __init__(self, texts: list[str]):
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.text = np.repeat(np.arange(len(texts)), self.size + 1)
        padded = np.r_[code, np.zeros(DEPTH, np.uint32)]
        low = ((padded ^ (padded >> 16)) & 0xFFFF).astype(np.uint64)
        self.stop = (padded == 0) | (padded == _BAR)
        inside = np.ones(len(code), bool)
        self.head, self.tail = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint64)
        for i in range(DEPTH):
            inside &= padded[i : i + len(code)] != 0
            symbol = np.where(inside, low[i : i + len(code)], 0) << np.uint64(16 * (3 - i % 4))
            if i < 4:
                self.head |= symbol
            else:
                self.tail |= symbol
        # Place inside the part: how far the last bar or start is.
        at = np.arange(len(code))
        after = np.maximum.accumulate(np.where(np.r_[True, self.stop[: len(code) - 1]], at, 0))
        self.place = at - after
        bars = np.bincount(self.text, weights=code == _BAR, minlength=len(texts))
        self.many = bars > 0
        bit = np.where(code != 0, np.uint64(1) << ((code.astype(np.uint64) * _MIX) >> np.uint64(40)) % np.uint64(63), np.uint64(0))
        self.bits = np.bitwise_or.reduceat(bit, self.start)
        self.width = np.zeros(len(texts), np.int64)
        anchors: list[int] = []
        for k, (t, a) in enumerate(zip(texts, self.start.tolist())):
            self.width[k], own = pieces(tuple(map(len, t.split("|"))))
            anchors += [a + i for i in own]
        self.pieces = np.array(anchors, np.int64)

    def keyed(self, at: np.ndarray, width: int) -> np.ndarray:
        """First characters of the suffixes, as one number; narrow ones carry their width as last character."""
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(16 * (4 - width))
        key = self.head[at] & keep
        return (key | (np.uint64(width) << np.uint64(16 * (4 - width - 1)))) >> np.uint64(16) if width < WIDTH else key >> np.uint64(16)

    def anchors(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, key, width and rank (rarest first) of as many pieces of each text as a partner may need."""
        at = self.pieces
        width = self.width[self.text[at]]
        key = np.zeros(len(at), np.uint64)
        for w in range(1, WIDTH + 1):
            own = width == w
            key[own] = self.keyed(at[own], w)
        order = np.lexsort((count[_slot(key, len(count))], self.text[at]))
        at, key, width = at[order], key[order], width[order]
        text = self.text[at]
        first = np.r_[True, text[1:] != text[:-1]] if len(at) else np.zeros(0, bool)
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        ok = rank <= self.size[text] // (SHARE - 1)
        return at[ok], key[ok], width[ok], rank[ok]

    def offered(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, key and width of the suffixes that pieces of these widths may meet."""
        n = len(self.text)
        ats, keys, widths = [], [], []
        inside = np.ones(n, bool)
        for w in range(1, WIDTH + 1):
            inside = inside & ~self.stop[w - 1 : w - 1 + n]
            at = np.flatnonzero(inside & asked[np.minimum(self.size, len(asked) - 1), w][self.text])
            ats.append(at)
            keys.append(self.keyed(at, w))
            widths.append(np.full(len(at), w))
        return np.concatenate(ats), np.concatenate(keys), np.concatenate(widths)


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key * _MIX) >> np.uint64(32)) % np.uint64(size)


# ---- what the driver knows: sample, bitmaps, widths ----------------------------------

LONG = 2_048


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sizes = b["canon"].map(lambda t: (min(len(t), LONG), pieces(tuple(map(len, t.split("|"))))[0]))
        yield pd.DataFrame(sorted(set(sizes)), columns=["size", "width"])


def asked_widths(asking: DataFrame) -> np.ndarray:
    """By size of an offering text and width: whether a text may ask for such suffixes. At most LONG by WIDTH rows reach the driver."""
    out = np.zeros((LONG + 1, WIDTH + 1), bool)
    for size, width in asking.select("canon").mapInPandas(_asked, "size int, width int").distinct().collect():
        # A partner has 4/5 to 5/4 of the length; all longer texts count as LONG.
        out[size - size // SHARE : size * SHARE // (SHARE - 1) + 1, width] = True
    return out


def _sampled(texts: DataFrame, n: int) -> list[str]:
    """Texts of a bounded sample, cut short for this purpose only."""
    rows = texts.sample(min(1.0, 1.5 * SAMPLE_TEXTS / max(n, 1)), seed=7).select(F.substring("canon", 1, 500).alias("canon")).limit(SAMPLE_TEXTS)
    return [r[0].strip("|") for r in rows.collect()]


class Plan:
    """Piece counts and boundaries from the sample."""

    SLOTS = 1 << 18

    def __init__(self, asking: DataFrame, offering: DataFrame):
        self.asked = asked_widths(asking)
        self.count = np.zeros(self.SLOTS, np.int64)
        keys, weights = [], []
        for texts, asks in ((offering, False), (asking, True)):
            n = texts.count()
            sample = _sampled(texts, n)
            if sample:
                own, scale = Suffixes(sample), max(1, n // len(sample))
                key = own.offered(self.asked)[1]
                np.add.at(self.count, _slot(key, self.SLOTS), scale)
                keys.append(own.anchors(self.count)[1] if asks else key)
                weights.append(np.full(len(keys[-1]), scale))
        self.bounds = np.zeros(0, np.uint64)
        if keys:
            key, weight = np.concatenate(keys), np.concatenate(weights)
            total = int(weight.sum())
            want = max(-(-total // PARTITION_SUFFIXES), min(total // 100_000, asking.sparkSession.sparkContext.defaultParallelism * 2))
            order = np.argsort(key)
            share = np.cumsum(weight[order])
            self.bounds = key[order][np.searchsorted(share, total * np.arange(1, want) / want)]


def _bitmap(offering: DataFrame, plan: Plan) -> np.ndarray:
    """Bits of the keys of all offered suffixes; at most BITS / 64 rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slot = np.unique(_slot(Suffixes(b["canon"].tolist()).offered(plan.asked)[1], BITS).astype(np.int64)) if len(b) else []
            if len(slot):
                word = slot >> 6
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                bit = np.uint64(1) << (slot & 63).astype(np.uint64)
                yield pd.DataFrame({"word": word[first], "bit": np.bitwise_or.reduceat(bit, first).view(np.int64)})

    words = offering.select("canon").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = _slot(key, BITS)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


# ---- suffixes in their partitions ------------------------------------------------------

#: ``place``: inside the part; ``about``: size << 32 | rank << 2 | many parts << 1 | asks.
_ENTRY = "part int, head long, text_id long, place int, about long, bits long"


def _placed(plan: Plan, known: np.ndarray | None):
    """Suffixes with their partition: anchors if ``known`` is the bitmap of what is offered, else what is offered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = Suffixes(b.column(1).to_pylist())
            ids = b.column(0).to_numpy()
            if known is not None:
                found = s.anchors(plan.count)
                ok = _has(known, found[1])
                at, key, width, rank = (x[ok] for x in found)
            else:
                at, key, width = s.offered(plan.asked)
                rank = np.zeros(len(at), np.int64)
            # A key that is several boundaries holds several shares: its anchors are split by record, its offers copied.
            lo, hi = np.searchsorted(plan.bounds, key, "left"), np.searchsorted(plan.bounds, key, "right")
            # A key equal to a boundary starts at its first partition; with one boundary it fills only part of two.
            reach = np.where(hi - lo > 1, hi - lo, 0) + 1
            text = s.text[at]
            if known is not None:
                part = lo + ((ids[text].astype(np.int64).view(np.uint64) * _MIX >> np.uint64(33)) % reach.astype(np.uint64)).astype(np.int64)
            else:
                who = np.repeat(np.arange(len(at)), reach)
                part = lo[who] + np.arange(len(who)) - np.repeat(np.cumsum(reach) - reach, reach)
                at, key, width, rank, text = at[who], key[who], width[who], rank[who], text[who]
            about = s.size[text] << 32 | rank << 2 | s.many[text].astype(np.int64) << 1 | (known is not None)
            columns = [part.astype(np.int32), (key << np.uint64(16)).view(np.int64), ids[text], s.place[at].astype(np.int32), about, s.bits[text].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _ENTRY.split(", ")])

    return run


def common_prefix(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Equal leading characters of each suffix and the one before it; the first has none."""

    def equal(x: np.ndarray) -> np.ndarray:
        return sum((x >> np.uint64(16 * (3 - i)) == 0).astype(np.int8) for i in range(4))

    a, b = equal(head[1:] ^ head[:-1]), equal(tail[1:] ^ tail[:-1])
    return np.r_[np.int8(0), np.where(a == 4, a + b, a)] if len(head) else np.zeros(0, np.int8)


def _once(at: np.ndarray, run: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One suffix of each text and interval, and whether there are more, so that their places say nothing."""
    at = at[np.lexsort((text[at], run[at]))]
    first = np.flatnonzero(np.r_[True, (run[at[1:]] != run[at[:-1]]) | (text[at[1:]] != text[at[:-1]])]) if len(at) else at
    return at[first], np.diff(np.r_[first, len(at)]) > 1


def _array(b: pd.DataFrame) -> pd.DataFrame:
    """Pairs of texts that meet in one partition's suffix array."""
    d = {k: b[k].to_numpy() for k in b.columns}
    order = np.argsort(d["head"].view(np.uint64), kind="stable")
    d = {k: v[order] for k, v in d.items()}
    head = d["head"].view(np.uint64)
    # Intervals of the suffix array: neighbours with a common prefix as long as a piece.
    run = (np.cumsum(common_prefix(head, head) < WIDTH) - 1).astype(np.int64) << 32
    asks_ = (d["about"] & 1).astype(bool)
    size, rank, place = d["about"] >> 32, (d["about"] & 0xFFFFFFFF) >> 2, d["place"].astype(np.int64)
    many = (d["about"] & 2).astype(bool)
    rest, more = _once(np.flatnonzero(~asks_), run, d["text_id"])
    many[rest] |= more
    where = run + np.where(many, np.int64(1 << 31), place)
    rest = rest[np.argsort(where[rest], kind="stable")]
    longest = rest[np.argsort(run[rest] + size[rest], kind="stable")]
    # The rarest pieces, one more than the edits, are enough: the others only ask texts so long that they allow more edits.
    ask = np.flatnonzero(asks_)
    late = rank[ask] > size[ask] // SHARE
    ask, last = ask[~late], ask[late]
    # Without bars on both sides the places differ by the edits at most; with bars anywhere is near.
    plain, free = ask[~many[ask]], ask[many[ask]]
    slack = size[plain] // (SHARE - 1)
    found = _meetings(d["text_id"], size, place, many, d["bits"], rest, where, np.r_[plain, plain, free],
        np.r_[run[plain] + np.maximum(0, place[plain] - slack), run[plain] + (1 << 31), run[free]],
        np.r_[run[plain] + place[plain] + slack, run[plain] + (1 << 31), run[free] + (1 << 31)])
    found += _meetings(d["text_id"], size, place, many, d["bits"], longest, run + size, last, run[last] + SHARE * rank[last], run[last] + size[last] * SHARE // (SHARE - 1))
    if not found:
        return pd.DataFrame({"ask": [], "offer": []}, dtype="int64")
    return pd.concat(found, ignore_index=True).drop_duplicates()


def _meetings(ids, size, place, many, bits, rest, where, asks, low, high) -> list[pd.DataFrame]:
    """Pairs of asking and offering texts, these in order of ``where`` and between ``low`` and ``high``, that the edits allow."""
    lo, hi = np.searchsorted(where[rest], low, "left"), np.searchsorted(where[rest], high, "right")
    some = np.flatnonzero(hi > lo)
    asks, lo, times = asks[some], lo[some], (hi - lo)[some]
    bound = np.cumsum(times)
    there = {k: v[rest] for k, v in {"size": size.astype(np.int32), "place": place.astype(np.int32), "many": many}.items()}
    mine = {k: v[asks] for k, v in {"size": size.astype(np.int32), "place": place.astype(np.int32), "many": many}.items()}
    found, at = [], 0
    while at < len(asks):
        base = bound[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(bound, base + CHUNK, "right")))
        n = times[at:to]
        m = np.repeat(lo[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        a, b = np.repeat(mine["size"][at:to], n), there["size"][m]
        edits = np.maximum(a, b) // SHARE
        # In a text without bars what is before and behind the piece can't do with fewer edits than their lengths differ by.
        before = np.repeat(mine["place"][at:to], n) - there["place"][m]
        apart = a - b
        least = np.where(np.repeat(mine["many"][at:to], n) | there["many"][m], np.abs(apart), np.abs(before) + np.abs(apart - before))
        ok = np.flatnonzero(least <= edits)
        q, m, edits = np.repeat(asks[at:to], n)[ok], rest[m[ok]], edits[ok]
        ok = np.bitwise_count(bits[q] ^ bits[m]) <= 2 * edits
        found.append(pd.DataFrame({"ask": ids[q[ok]], "offer": ids[m[ok]]}).drop_duplicates())
        at = to
    return found


# ---- distance and coverage -----------------------------------------------------------------


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, ``most`` + 1 if it is more; one big number holds a column of the table."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for k, c in enumerate(b):
        same = seen.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(flat | up) & full, up & flat
        score += bool(rise & last) - bool(fall & last)
        if score - (len(b) - k - 1) > most:
            return most + 1
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(flat | rise)) & full, rise & flat & full
    return score


def _assigned(a: list[str], b: list[str], most: int) -> int:
    """Equal parts cancel out; the rest meets by the cheapest pairs first, left-over parts are dropped or added with their bars."""
    left, right = list(a), []
    for p in b:
        if p in left:
            left.remove(p)
        else:
            right.append(p)
    cost = sorted((edits(p, q, most), i, j) for i, p in enumerate(left) for j, q in enumerate(right) if abs(len(p) - len(q)) <= most)
    used_i: set[int] = set()
    used_j: set[int] = set()
    total = 0
    for c, i, j in cost:
        if i not in used_i and j not in used_j and c <= most:
            used_i.add(i)
            used_j.add(j)
            total += c
    total += sum(len(p) + 1 for i, p in enumerate(left) if i not in used_i) + sum(len(p) + 1 for j, p in enumerate(right) if j not in used_j)
    return min(total, most + 1)


def near(a: str, b: str) -> bool:
    """Whether the distance is at most a fifth of the longer text."""
    most = max(len(a), len(b)) // SHARE
    # No order of the parts changes which characters there are.
    if max(len(a), len(b)) - sum(min(n, b.count(c)) for c, n in Counter(a).items()) > most:
        return False
    if edits(a, b, most) <= most:
        return True
    if "|" not in a and "|" not in b:
        return False
    p, q = a.split("|"), b.split("|")
    if _assigned(p, q, most) <= most:
        return True
    if max(len(p), len(q)) > ORDERED:
        return False
    return any(edits("|".join(x), "|".join(y), most) <= most for x in permutations(p) for y in permutations(q))


def covered_by(a: str, b: str) -> int:
    """Characters of ``a`` in passages of at least WIDTH characters common with ``b``."""
    if a == b:
        return len(a)
    grams = {b[j : j + WIDTH] for j in range(len(b) - WIDTH + 1)}
    on = bytearray(len(a))
    for i in range(len(a) - WIDTH + 1):
        if a[i : i + WIDTH] in grams:
            on[i : i + WIDTH] = b"\1" * WIDTH
    return sum(on)


@F.pandas_udf(T.LongType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters covered, null if the texts are too far apart."""
    return pd.Series([covered_by(x, y) if near(x, y) else None for x, y in zip(a, b)], dtype="Int64")


def _texts(canon: DataFrame) -> DataFrame:
    return canon.groupBy("canon").agg(F.min("row_id").alias("text_id")).select("text_id", "canon")


def overlaps(train: DataFrame, evals: DataFrame) -> DataFrame:
    """``train_row_id, eval_row_id, covered``: all overlapping pairs of two canonical tables.

    ``covered``: characters of the training text inside the common passages.
    """
    texts_t, texts_e = cut(_texts(train)), cut(_texts(evals))
    chars = [t.agg(F.sum(F.length("canon"))).first()[0] or 0 for t in (texts_t, texts_e)]
    asking, offering, names = (texts_t, texts_e, ("t", "e")) if chars[0] >= chars[1] else (texts_e, texts_t, ("e", "t"))
    plan = Plan(asking, offering)
    anchors = asking.select("text_id", "canon").mapInArrow(_placed(plan, _bitmap(offering, plan)), _ENTRY)
    offers = offering.select("text_id", "canon").mapInArrow(_placed(plan, None), _ENTRY)
    pairs = anchors.unionByName(offers).groupBy("part").applyInPandas(_array, "ask long, offer long").select(F.col("ask").alias(names[0]), F.col("offer").alias(names[1]))
    named_t, named_e = texts_t.select(F.col("text_id").alias("t"), F.col("canon").alias("a")), texts_e.select(F.col("text_id").alias("e"), F.col("canon").alias("b"))
    met = cut(pairs.distinct()).join(named_e, "e").join(named_t, "t")
    close = met.withColumn("covered", _confirmed("a", "b")).where("covered is not null").select("a", "b", "covered")
    # Texts too short for an edit have no pieces.
    small = f"length(canon) < {SHARE - 1}"
    same = texts_t.where(small).join(texts_e.where(small), "canon").select(F.col("canon").alias("a"), F.col("canon").alias("b"), F.length("canon").cast("long").alias("covered"))
    found = cut(close.unionByName(same))
    rows_t, rows_e = train.select(F.col("row_id").alias("train_row_id"), F.col("canon").alias("a")), evals.select(F.col("row_id").alias("eval_row_id"), F.col("canon").alias("b"))
    return found.join(rows_e, "b").join(rows_t, "a").select("train_row_id", "eval_row_id", "covered")


def report(pairs: DataFrame, evals: DataFrame) -> DataFrame:
    """Per split and source of the evaluation rows: leaked rows, pairs, characters of training texts covered, rows."""
    hit = pairs.groupBy(F.col("eval_row_id").alias("row_id")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("covered").alias("covered"))
    return (
        evals.select("row_id", "split_name", "source")
        .join(hit, "row_id", "left")
        .groupBy("split_name", "source")
        .agg(F.count(F.lit(1)).alias("eval_rows"), F.count("pairs").alias("leaked_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "covered")])
    )
