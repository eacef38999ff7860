"""Frequency of every distinct term (problem 6): range-partitioned sort and run-length scan.

1. Pairs of term and record are counted per input batch. A batch's pairs go on as
   postings: one row for a term and a range of records, with the sorted records
   and how often each holds the term.
2. Postings are range-partitioned by term and range of records; the boundaries of
   both come from one bounded sample. A term in every record so fills several
   partitions, none of them more than its share, and a record's pairs with one
   term always meet.
3. Each partition is sorted externally and scanned once: runs of equal keys, and
   inside them runs of equal records, give occurrences and distinct records. One
   row per term and range of records is left to add up.

A null or blank token is no term. Terms are compared exactly as they stand, by
their bytes. A record is a row id; rows that share one are one record. Records
whose token list is null don't count, empty lists do. A record of any length,
and an empty table, are fine; an empty table has no terms.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_BELOW = 2
COMMON_ABOVE = 0.8
SAMPLE_ROWS = 4_000
BATCH_TOKENS = 1_000_000
ROW_PAIRS = 65_536
# The blanks of Unicode.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*")


def _pairs(record: np.ndarray, tokens: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and the distinct pairs of term number and record in order, with their counts."""
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    names = words.dictionary.to_pylist()
    blank = np.fromiter((_BLANK.fullmatch(w) is not None for w in names), bool, len(names))
    owner = np.repeat(record, size)
    ok = (code >= 0) & ~np.append(blank, True)[code]
    code, owner = code[ok], owner[ok]
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, np.int64)
    return names, code[first], owner[first], np.diff(np.r_[first, len(code)])


class Plan:
    """Ranges of records and of (term, range), from a sample of at most SAMPLE_ROWS records."""

    def __init__(self, rows: DataFrame):
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        self.parts = max(1, -(-total // BATCH_TOKENS), min(-(-total // 50_000), rows.sparkSession.sparkContext.defaultParallelism * 2))
        # Long records are cut short for the sample only.
        short = rows.select("record", F.slice("tokens", 1, 500).alias("tokens"))
        got = short.sample(min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1)), seed=3).limit(SAMPLE_ROWS).toArrow().combine_chunks()
        self.ranges, self.bounds = np.zeros(0, np.int64), []
        if got.num_rows and self.parts > 1:
            record = got["record"].to_numpy()
            self.ranges = np.unique(np.sort(record)[len(record) * np.arange(1, self.parts) // self.parts])
            names, code, owner, times = _pairs(record, got["tokens"].combine_chunks())
            keys = sorted(zip([names[c].encode() for c in code.tolist()], self.range_of(owner).tolist()))
            self.bounds = [keys[len(keys) * i // self.parts] for i in range(1, self.parts)] if keys else []

    def range_of(self, record: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ranges, record, "right")

    def part_of(self, key: tuple[bytes, int]) -> int:
        return bisect_right(self.bounds, key)


_POSTING = "part int, term string, records_of int, records array<long>, times array<long>"


def _postings(plan: Plan):
    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        names, code, owner, times = _pairs(t["record"].to_numpy(), t["tokens"].combine_chunks())
        where = plan.range_of(owner)
        new = np.r_[True, (code[1:] != code[:-1]) | (where[1:] != where[:-1])] if len(code) else np.zeros(0, bool)
        # Long runs are several rows.
        at = np.arange(len(code))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % ROW_PAIRS == 0
        first = np.flatnonzero(new)
        ends = pa.array(np.append(first, len(code)).astype(np.int32))
        terms = [names[c] for c in code[first].tolist()]
        ranges = where[first]
        part = [plan.part_of((w.encode(), r)) for w, r in zip(terms, ranges.tolist())]
        columns = [pa.array(part, pa.int32()), pa.array(terms, pa.string()), pa.array(ranges, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(owner)), pa.ListArray.from_arrays(ends, pa.array(times))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "term", "records_of", "records", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("tokens").flatten())
            if size >= BATCH_TOKENS:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return run


def _counted(term: list[str], key: np.ndarray, record: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Occurrences and distinct records of whole runs; ``key`` numbers the run of each pair."""
    order = np.lexsort((record, key))
    key, record, times = key[order], record[order], times[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    new = np.r_[True, (key[1:] != key[:-1]) | (record[1:] != record[:-1])]
    return pa.RecordBatch.from_arrays(
        [pa.array(term, pa.string()), pa.array(np.add.reduceat(times, start)), pa.array(np.add.reduceat(new.astype(np.int64), start))],
        ["term", "occurrences", "records"],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a sorted partition; the last run of a batch waits for the next batch."""
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    name: tuple[str, int] | None = None

    def closed() -> pa.RecordBatch:
        record, times = (np.concatenate(x) for x in zip(*open_))
        return _counted([name[0]], np.zeros(len(record), np.int64), record, times)

    for b in batches:
        if not b.num_rows:
            continue
        term, where = b.column("term").to_pylist(), b.column("records_of").to_numpy()
        size = pc.list_value_length(b.column("records")).to_numpy()
        record, times = (b.column(c).flatten().to_numpy() for c in ("records", "times"))
        run = np.cumsum([True] + [term[i] != term[i - 1] or where[i] != where[i - 1] for i in range(1, len(term))]) - 1
        ends = np.cumsum(size)
        head, tail = int(ends[np.flatnonzero(run == 0)[-1]]), int(ends[np.flatnonzero(run < run[-1])[-1]]) if run[-1] else 0
        if name is not None and name != (term[0], int(where[0])):
            yield closed()
            open_, name = [], None
        if name is not None:
            open_.append((record[:head], times[:head]))
            if run[-1] == 0:
                continue
            yield closed()
            open_, lo, first = [], head, 1
        else:
            lo, first = 0, 0
        if tail > lo:
            heads = [term[i] for i in np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).tolist()][first : int(run[-1])]
            yield _counted(heads, np.repeat(run, size)[lo:tail], record[lo:tail], times[lo:tail])
        open_, name = [(record[tail:], times[tail:])], (term[-1], int(where[-1]))
    if open_:
        yield closed()


def frequencies(df: DataFrame, record: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """``term, occurrences, records`` of every term."""
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(tokens).alias("tokens")).where("record is not null and size(tokens) > 0")
    plan = Plan(rows)
    placed = rows.mapInArrow(_postings(plan), _POSTING).repartitionById(plan.parts, "part").sortWithinPartitions("term", "records_of")
    parts = placed.select("term", "records_of", "records", "times").mapInArrow(_scan, "term string, occurrences long, records long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, df: DataFrame, record: str = "row_id", tokens: str = "tokens", rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``counts`` with ``mark``: rare, common or null."""
    total = df.where(F.col(tokens).isNotNull()).agg(F.count_distinct(F.col(record)).alias("total"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("total"), "common")
    # One row, so a broadcast of proven size.
    return counts.join(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
