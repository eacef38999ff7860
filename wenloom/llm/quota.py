"""Samples that match target proportions (problem 3): top-down quotas, permuted dense rank.

A plan wants of each category the larger of its minimum and its share of the
sample, rounded half up. Categories are the leaves of a tree; redelivered rows
are one record by their key.

1. Count the distinct records of each category.
2. Walk the tree from the top. Every node asks for the sum of its leaves'
   needs. What a leaf can't fill is passed first to its siblings, then to the
   leaves of its parent's siblings and so on, each time in proportion to what
   they have left (largest remainder, ties by label).
3. Draw at the leaves: records are permuted by a hash of key and seed; the
   dense rank in that order says which are drawn. The rank of a record is the
   count of smaller hash buckets of its category plus its rank in its bucket,
   so no category is ever sorted in one task.

Each plan is allocated by itself, in the task of its rows; only one plan's
categories are in one place.

Defined cases: rows without key or label are no records; a record with two
labels counts in both; a null share or minimum is zero; a plan or category
that train lacks is reported as short of all it needs; an empty plan table
gives empty results; of a record's rows the one with the smallest row id is
drawn.
"""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def needed(plans: DataFrame) -> DataFrame:
    """``plan_id, label_id, needed`` of each row of the plans."""
    share = F.coalesce(F.round(F.col("target_share").cast("decimal(20,12)") * F.col("sample_rows")), F.lit(0)).cast("long")
    return plans.select("plan_id", "label_id", F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)), share).cast("long").alias("needed"))


def records(train: DataFrame, seed: int = 42, key: str = "headline_key", label: str = "label_id") -> DataFrame:
    """``label_id, key, row_id, bucket``: the distinct records of each category."""
    rows = train.select(F.col(label).alias("label_id"), F.col(key).alias("key"), F.col("row_id")).where("key is not null and label_id is not null")
    return (
        rows.groupBy("label_id", "key")
        .agg(F.min("row_id").alias("row_id"))
        .withColumn("mix", F.xxhash64("key", F.lit(seed)))
        .withColumn("bucket", F.pmod("mix", F.lit(BUCKETS)).cast("int"))
    )


def counts(distinct: DataFrame) -> DataFrame:
    """``label_id, bucket, n``: at most BUCKETS rows a category."""
    return distinct.groupBy("label_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _spread(amount: int, room: dict) -> dict:
    """``amount`` over ``room`` in proportion, never more than the room."""
    total = sum(room.values())
    amount = min(amount, total)
    if not amount:
        return {}
    exact = {k: Fraction(amount * v, total) for k, v in room.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(room, key=lambda k: (out[k] - exact[k], str(k)))[: amount - sum(out.values())]:
        out[k] += 1
    return out


def allocate(paths: dict, need: dict, have: dict) -> dict:
    """How many each leaf gives: ``paths`` has each leaf's ancestors from the root on."""
    give = {leaf: min(n, have.get(leaf, 0)) for leaf, n in need.items()}
    gap = {leaf: n - give[leaf] for leaf, n in need.items()}
    depth = max((len(paths.get(x, ())) for x in need), default=0)
    for up in range(depth, -1, -1):
        # Leaves below the same ancestor: siblings first, then cousins.
        groups = defaultdict(list)
        for leaf in need:
            groups[tuple(paths.get(leaf, ())[:up])].append(leaf)
        for leaves in groups.values():
            missing = sum(gap[x] for x in leaves)
            room = {x: have.get(x, 0) - give[x] for x in leaves if have.get(x, 0) > give[x]}
            if not missing or not room:
                continue
            extra = _spread(missing, room)
            for x, n in extra.items():
                give[x] += n
            left = sum(extra.values())
            for x in sorted(leaves, key=lambda x: (-gap[x], str(x))):
                take = min(left, gap[x])
                gap[x] -= take
                left -= take
    return give


def plan_report(plans: DataFrame, count: DataFrame, tree: DataFrame) -> DataFrame:
    """``plan_id, label_id, needed, available, drawn, short`` per plan and category.

    ``tree``: ``label_id, path`` with the names of the ancestors.
    """
    have = count.groupBy("label_id").agg(F.sum("n").alias("available"))
    cells = needed(plans).join(have, "label_id", "left").join(tree.select("label_id", "path"), "label_id", "left")
    cells = cells.select("plan_id", "label_id", "needed", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))

    def allocated(b: pd.DataFrame) -> pd.DataFrame:
        # Rows without a category ask for nothing that exists.
        own = b.astype({"label_id": object}).where(b["label_id"].notna(), None).to_dict("records")
        need: dict = defaultdict(int)
        for r in own:
            need[r["label_id"]] = max(need[r["label_id"]], int(r["needed"]))
        have = {r["label_id"]: int(r["available"]) for r in own}
        give = allocate({r["label_id"]: tuple(r["path"]) for r in own}, need, have)
        out = [(b["plan_id"].iloc[0], leaf, n, have[leaf], give[leaf], max(0, n - have[leaf])) for leaf, n in need.items()]
        return pd.DataFrame(out, columns=["plan_id", "label_id", "needed", "available", "drawn", "short"]).astype({"label_id": "Int32"})

    return cells.groupBy("plan_id").applyInPandas(allocated, "plan_id int, label_id int, needed long, available long, drawn long, short long")


def draw(distinct: DataFrame, count: DataFrame, report: DataFrame) -> DataFrame:
    """``plan_id, label_id, row_id`` of every drawn record."""
    before = count.withColumn("before", F.sum("n").over(Window.partitionBy("label_id").orderBy("bucket")) - F.col("n")).drop("n")
    most = report.groupBy("label_id").agg(F.max("drawn").alias("most"))
    # At most BUCKETS rows a category; buckets beyond every quota are never ranked.
    wanted = before.join(most, "label_id").where("before < most").drop("most")
    rank = F.row_number().over(Window.partitionBy("label_id", "bucket").orderBy("mix", "key"))
    # Adaptive execution broadcasts the plans where they are few.
    ranked = distinct.join(wanted, ["label_id", "bucket"]).withColumn("rank", F.col("before") + rank)
    plans = report.select("plan_id", "label_id", "drawn").where("drawn > 0")
    return ranked.join(plans, "label_id").where("rank <= drawn").select("plan_id", "label_id", "row_id")
