"""Word segmentation by a dictionary, over Arrow batches.

Runs of letters, digits and underscores of other scripts are words as they stand;
other characters that no word covers are tokens of one character; blanks are none.
Ideographs are cut by a dictionary, which a user dictionary may add to:

* ``longest``: from left to right the longest word that fits.
* ``likely``: the cut with the largest product of word shares (words' counts by
  the sum of all counts); a character that is no word counts half.

Null gives null, empty text no tokens; texts of any length are cut whole. A
dictionary is sent to the tasks, so it has at most MOST_WORDS words.
"""

from __future__ import annotations

import math

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_WORDS = 2_000_000
_RUNS = regex.compile(r"(?V1)([[\p{L}\p{N}_]--\p{Han}]+)|(\p{Han}+)|(\S)")


class Segmenter:
    def __init__(self, words: dict[str, int] | list[str], user: dict[str, int] | list[str] = (), method: str = "longest"):
        if method not in ("longest", "likely"):
            raise ValueError(f"unknown method: {method}")
        counts = [x if isinstance(x, dict) else dict.fromkeys(x, 1) for x in (words, user)]
        if sum(map(len, counts)) > MOST_WORDS:
            raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
        most = max([1, *counts[0].values()])
        # A word of the user outweighs those of the dictionary.
        self.counts = {w: c for w, c in counts[0].items() if w} | {w: max(c, most) for w, c in counts[1].items() if w}
        self.reach: dict[str, int] = {}
        for w in self.counts:
            self.reach[w[0]] = max(self.reach.get(w[0], 1), len(w))
        self.method = method
        self.total = math.log(max(1, sum(self.counts.values())))

    def _longest(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            n = next((n for n in range(min(self.reach.get(text[at], 1), len(text) - at), 1, -1) if text[at : at + n] in self.counts), 1)
            out.append(text[at : at + n])
            at += n
        return out

    def _likely(self, text: str) -> list[str]:
        best, step = [0.0] * (len(text) + 1), [1] * len(text)
        for at in reversed(range(len(text))):
            found = []
            for n in range(1, min(self.reach.get(text[at], 1), len(text) - at) + 1):
                count = self.counts.get(text[at : at + n], 0.5 if n == 1 else 0)
                if count > 0:
                    found.append((math.log(count) - self.total + best[at + n], n))
            best[at], step[at] = max(found)
        out, at = [], 0
        while at < len(text):
            out.append(text[at : at + step[at]])
            at += step[at]
        return out

    def cut(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        split = self._longest if self.method == "longest" else self._likely
        out: list[str] = []
        for m in _RUNS.finditer(text):
            out += split(m[2]) if m[2] else [m[0]]
        return out

    def column(self, text: Column) -> Column:
        own = self

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(t: pd.Series) -> pd.Series:
            return t.map(own.cut)

        return run(text)


def read_words(spark: SparkSession, path: str) -> dict[str, int]:
    """Words of a file: one per line, optionally followed by a blank and a count; what follows is left out."""
    line = F.split(F.trim("value"), r"\s+")
    rows: DataFrame = spark.read.text(path).where(F.trim("value") != "").select(line[0].alias("w"), F.coalesce(F.try_element_at(line, F.lit(2)).try_cast("long"), F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.max("n").alias("n")).limit(MOST_WORDS).collect()}
