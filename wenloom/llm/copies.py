"""Duplicates hidden by formatting (problem 5): bottom-up hashing of nested records.

A record is a tree: its text is an unordered node whose leaves are the parts
between vertical bars. Leaves are normalised, each leaf gets a digest, the
sorted child digests give the root digest, and rows are grouped by the root
digest together with the whole normalised structure, so that two records meet
only if the structures are equal, not merely their digests.

Defined cases: null, empty and blank texts and texts without a letter or digit
are no records and come out nowhere; equal row ids stay separate copies; a
column of another name clashing with the working columns is never read. An
empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wenloom.llm import looks


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leaves(text: pd.Series) -> pd.Series:
    return text.map(lambda t: looks.parts(t) if looks.has_word(t) else None)


def canonical(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """``row_id, leaves, root`` of every record; rows without a word are left out."""
    leaves = df.select(F.col(row_id).alias("row_id"), _leaves(F.col(text)).alias("leaves")).where(F.col("leaves").isNotNull())
    digests = F.sort_array(F.transform("leaves", lambda p: F.xxhash64(p)))
    return leaves.select("row_id", "leaves", F.xxhash64(digests).alias("root"))


def collapse(records: DataFrame) -> DataFrame:
    """One row per distinct record: ``root, leaves, first_row_id, copies``.

    Copies are counted before the shuffle, so a record that holds a third of
    all rows reaches its task as one row per map task.
    """
    return records.groupBy("root", "leaves").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("copies"))


def members(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``first_row_id, row_id`` of every later copy.

    A plain equi-join above two exchanges, which adaptive execution splits
    where one record's copies fill a partition.
    """
    repeated = groups.where("copies > 1").select("root", "leaves", "first_row_id")
    return records.join(repeated, ["root", "leaves"]).where("row_id <> first_row_id").select("first_row_id", "row_id")
