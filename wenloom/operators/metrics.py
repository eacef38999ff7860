"""Classification metrics from predictions: tables of ``y`` and ``p``, optionally grouped.

One aggregation to counts of true and predicted label (a table of classes
squared) precedes everything, so all later steps are on a few rows. Defined
cases: rows with a null label or prediction are left out; 0 / 0 is 0; labels
that only one side has count for the averages; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """``y, p, n``."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(by or []), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def label_universe(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return pairs.select(*by, F.col("y").alias("label")).union(pairs.select(*by, F.col("p").alias("label"))).distinct()


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """``y, p, n`` for all pairs of labels, zeros included; labels are a small set."""
    labels = label_universe(pairs)
    grid = labels.select(F.col("label").alias("y")).join(F.broadcast(labels.select(F.col("label").alias("p"))))
    return grid.join(pairs, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def per_class(pairs: DataFrame, by: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """``label, tp, fp, fn, support, precision, recall, f1``."""
    by = by or []
    both = pairs.select(*by, F.explode(F.array_distinct(F.array("y", "p"))).alias("label"), "y", "p", "n")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    own, guess = F.col("y") == F.col("label"), F.col("p") == F.col("label")
    out = both.groupBy(*by, "label").agg(count(own & guess).alias("tp"), count(~own & guess).alias("fp"), count(own & ~guess).alias("fn"), count(own).alias("support"))
    if labels is not None:
        out = out.where(F.col("label").isin(labels))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``average, precision, recall, f1``: macro, weighted and micro, and macro with the f1 of its means."""
    by = by or []
    mean = lambda c: F.avg(c)
    weigh = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro_p, micro_r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    one = lambda name, p, r, f: F.struct(F.lit(name).alias("average"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
    harmonic = lambda p, r: _ratio(2 * p * r, p + r)
    rows = F.array(
        one("macro", mean("precision"), mean("recall"), mean("f1")),
        one("macro_of_means", mean("precision"), mean("recall"), harmonic(mean("precision"), mean("recall"))),
        one("weighted", weigh("precision"), weigh("recall"), weigh("f1")),
        one("micro", micro_p, micro_r, harmonic(micro_p, micro_r)),
    )
    out = classes.groupBy(*by).agg(rows.alias("rows")).select(*by, F.explode("rows").alias("r")).select(*by, "r.*")
    return out.where("precision is not null")


def accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or [])).agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def classification_report(pairs: DataFrame, names: dict | None = None) -> DataFrame:
    """``ordinal, label, precision, recall, f1, support``: classes, then accuracy, macro and weighted."""
    classes = per_class(pairs)
    text = F.col("label").cast("string")
    if names:
        named = F.create_map(*[F.lit(x) for k, v in names.items() for x in (str(k), v)])
        text = F.coalesce(F.try_element_at(named, text), text)
    detail = classes.select(F.lit(0).alias("ordinal"), text.alias("label"), "precision", "recall", "f1", "support")
    total = classes.agg(F.sum("support").alias("support"))
    acc = accuracy(pairs).join(F.broadcast(total)).select(F.lit(1).alias("ordinal"), F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"), "support")
    rest = averages(classes).where("average in ('macro', 'weighted')").join(F.broadcast(total))
    rest = rest.select(F.when(F.col("average") == "macro", 2).otherwise(3).alias("ordinal"), F.concat("average", F.lit(" avg")).alias("label"), "precision", "recall", "f1", "support")
    return detail.unionByName(acc).unionByName(rest)


def formatted(report: DataFrame, digits: int = 4) -> str:
    """The report as text; it has a row per class."""
    rows = report.orderBy("ordinal", "label").collect()
    width = max([len(r["label"]) for r in rows] + [12])
    show = lambda x: " " * (digits + 2) if x is None else f"{x:.{digits}f}"
    return "\n".join(f"{r['label']:>{width}}  {show(r['precision'])}  {show(r['recall'])}  {show(r['f1'])}  {r['support']:>8}" for r in rows)


def model_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision, recall and f1, weighted f1 and micro f1 per group."""
    by = by or []
    pairs = pair_counts(df, by)
    avg = averages(per_class(pairs, by), by)
    pick = lambda a, c: F.max(F.when(F.col("average") == a, F.col(c)))
    wide = avg.groupBy(*by).agg(pick("macro", "precision").alias("macro_precision"), pick("macro", "recall").alias("macro_recall"), pick("macro", "f1").alias("macro_f1"), pick("weighted", "f1").alias("weighted_f1"), pick("micro", "f1").alias("micro_f1"))
    acc = accuracy(pairs, by)
    return acc.join(wide, by) if by else acc.join(F.broadcast(wide))


def best_model(metrics: DataFrame, metric: str = "macro_f1", ordinal: str = "ordinal") -> DataFrame:
    """The first model with the largest metric; no row if there is none."""
    return metrics.orderBy(F.desc(metric), ordinal).limit(1)
