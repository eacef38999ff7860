"""Labelled corpora: loading, class selection, sampling, folds.

Rows are matched by id, never by position. Order within a class or table is
that of a keyed hash (md5 of id and seed, then id), which any engine can
reproduce. Defined cases: rows with a null label belong to no class; ids may
repeat, ties stay in the order of the id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``text, label_id`` of the lines that are exactly text, tab, whole number; others are skipped.

    A missing file raises; bytes that aren't UTF-8 are dropped.
    """
    fixed = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return labeled_lines(spark.read.text(path).select(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(fixed).alias("value")), "value")


def labeled_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """As ``read_tsv``, of a table of lines; other columns stay."""
    stripped = F.regexp_replace(F.col(line), r"(?U)\A\s+|\s+\z", "")
    fields = F.split(stripped, "\t", -1)
    number = F.regexp_replace(fields[1], r"(?U)\A\s+|\s+\z", "")
    kept = df.where((F.size(fields) == 2) & number.rlike(r"^[+-]?[0-9]+$"))
    return kept.select(*[c for c in df.columns if c not in ("text", "label_id", line)], fields[0].alias("text"), number.try_cast("int").alias("label_id")).where("label_id is not null")


def labeled(df: DataFrame, classes: DataFrame, selected: bool = False) -> DataFrame:
    """With the class names; unknown and null labels drop out. ``classes`` is a table of a few rows."""
    names = classes.where("selected") if selected else classes
    return df.join(names.select("label_id", "name", "name_cn"), "label_id")


def select_classes(df: DataFrame, classes: list[str], column: str = "name") -> DataFrame:
    return df.where(F.col(column).isin(classes))


def class_distribution(df: DataFrame, label: str = "label_id") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def keyed(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(row_id).cast("string"), F.lit(str(seed))))


def _bucket(key: str = "__key") -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def ranked(df: DataFrame, groups: list[str], row_id: str, seed: int = 42) -> DataFrame:
    """``rank`` from 1 in the keyed order within each group.

    Hash buckets split a group, so that none is sorted in one task: the rank is
    the size of the earlier buckets, at most BUCKETS a group, plus the rank in
    the bucket.
    """
    own = df.withColumn("__key", keyed(row_id, seed)).withColumn("__bucket", _bucket())
    size = own.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__bucket")) - F.col("__n")
    offset = size.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("__b"), before.alias("__before"))
    match = own["__bucket"] == F.col("__b")
    for i, g in enumerate(groups):
        match = match & own[g].eqNullSafe(F.col(f"__g{i}"))
    inner = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy("__key", row_id))
    placed = own.withColumn("__inner", inner).join(offset, match)
    return placed.withColumn("rank", (F.col("__before") + F.col("__inner")).cast("long")).select(*df.columns, "rank")


def stratified_sample(df: DataFrame, per_class: int | None, label: str = "label_id", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, without replacement; None keeps all."""
    if per_class is None:
        return df
    return ranked(df.where(F.col(label).isNotNull()), [label], row_id, seed).where(F.col("rank") <= per_class).drop("rank")


def kfold(df: DataFrame, k: int = 5, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """``fold`` from 0: contiguous ranges of the shuffled order, the first n % k folds one longer."""
    n = df.agg(F.count(F.lit(1)).alias("__total"))
    own = ranked(df.withColumn("__one", F.lit(1)), ["__one"], row_id, seed).drop("__one").join(F.broadcast(n))
    at, q, r = F.col("rank") - 1, F.floor(F.col("__total") / k), F.col("__total") % k
    long = r * (q + 1)
    fold = F.when(at < long, F.floor(at / (q + 1))).otherwise(r + F.floor((at - long) / F.greatest(q, F.lit(1))))
    return own.withColumn("fold", fold.cast("int")).drop("rank", "__total")


def with_split(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """train, val and test 7 : 2 : 1 by the id's last digit."""
    last = F.pmod(F.col(row_id), F.lit(10))
    return df.withColumn("split", F.when(last < 7, "train").when(last < 9, "val").otherwise("test"))


def bootstrap(df: DataFrame, trees: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """``tree, row_id, times``: n draws with replacement of n rows for each tree.

    Draw d of a tree takes the row whose rank in the keyed order is a hash of
    tree, draw and seed modulo n; equal draws are counted before the join.
    """
    rows = ranked(df.select(row_id).withColumn("__one", F.lit(1)), ["__one"], row_id, seed).select(row_id, F.col("rank").alias("pick"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    draws = rows.select((F.col("pick") - 1).alias("draw")).join(F.broadcast(n)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    mixed = F.md5(F.concat_ws("-", F.col("tree").cast("string"), F.col("draw").cast("string"), F.lit(str(seed))))
    pick = (F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long") % F.col("n")) + 1
    times = draws.select("tree", pick.alias("pick")).groupBy("tree", "pick").agg(F.count(F.lit(1)).alias("times"))
    return times.join(rows, "pick").select("tree", row_id, "times")


def row_subsample(df: DataFrame, rate: float, groups: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """``grp`` and row: int(n * rate) rows without replacement, afresh for each group."""
    own = df.select(row_id).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = own.withColumn("__id", F.concat_ws("-", F.col("grp").cast("string"), F.col(row_id).cast("string")))
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(rate)).alias("__most"))
    return ranked(own, ["grp"], "__id", seed).join(F.broadcast(n)).where(F.col("rank") <= F.col("__most")).select("grp", row_id)


def label_index(df: DataFrame, label: str) -> DataFrame:
    """``label, idx``: distinct labels in sorted order, from 0; a label set is small by nature."""
    distinct = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return distinct.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def together(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several splits with their ``split``."""
    out = None
    for name, df in frames.items():
        own = df.withColumn("split", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def token_stats(df: DataFrame, by: str = "split_name", tokens: str = "tokens") -> DataFrame:
    """``by, n, mean_tokens`` of the rows that have a token list."""
    return df.where(F.col(tokens).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens)).alias("mean_tokens"))


def first_rows(df: DataFrame, n: int, by: str = "split", row_id: str = "row_id") -> DataFrame:
    """The first n rows of each split by id, for a look at them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(row_id))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def shortened(text: Column, size: int = 50) -> Column:
    """For display: the first characters, and dots if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
