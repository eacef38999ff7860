"""Command line: ``python -m wenloom train|evaluate|predict``; tables are Parquet with ``row_id, text, y``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wenloom.operators.segment import Segmenter, read_words
from wenloom.plans import pipeline

MODELS = {"naive_bayes": {}, "logistic_regression": {}, "random_forest": {}, "gbdt": {}, "knn": {}}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="wenloom", description=__doc__)
    modes = out.add_subparsers(dest="mode", required=True)
    train = modes.add_parser("train", help="fit features and ensemble, and save them")
    train.add_argument("--train", required=True)
    train.add_argument("--val", required=True)
    train.add_argument("--stopwords")
    train.add_argument("--words", help="dictionary for word segmentation")
    train.add_argument("--user-words", help="further words, which outweigh the dictionary's")
    train.add_argument("--models", nargs="+", default=list(MODELS))
    train.add_argument("--size", type=int, default=100, help="dimensions of the reduced features")
    evaluate = modes.add_parser("evaluate", help="metrics of labelled tables")
    evaluate.add_argument("--table", action="append", required=True, help="name=path, more than once")
    predict = modes.add_parser("predict", help="the label of one text")
    predict.add_argument("text")
    for mode in (evaluate, predict):
        mode.add_argument("--method", choices=["voting", "stacking"], default="voting")
    for mode in (train, evaluate, predict):
        mode.add_argument("--model", required=True, help="folder of the saved model")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wenloom").getOrCreate()
    if args.mode == "train":
        stop = pipeline.stopwords(spark, args.stopwords) if args.stopwords else None
        user = read_words(spark, args.user_words) if args.user_words else {}
        cutter = Segmenter(read_words(spark, args.words) if args.words else {}, user) if args.words or user else "ideographic"
        rows = (spark.read.parquet(p) for p in (args.train, args.val))
        pipeline.train(*rows, {m: MODELS.get(m, {}) for m in args.models}, stop, pipeline.Features(size=args.size), tokenizer=cutter).save(spark, args.model)
        return 0
    model = pipeline.Classifier.load(spark, args.model)
    if args.mode == "evaluate":
        tables = dict(t.split("=", 1) for t in args.table)
        model.evaluate({n: spark.read.parquet(p) for n, p in tables.items()}, args.method).show(truncate=False)
    else:
        print(model.predict_text(spark, args.text, args.method))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
