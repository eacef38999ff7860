import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wenloom.__main__ import main
from wenloom.operators import corpus, reduce
from wenloom.operators.segment import Segmenter, read_words
from wenloom.plans import pipeline


def brute(text, words, score):
    """The best of all cuts of a short text."""
    if not text:
        return [()]
    out = []
    for n in range(1, len(text) + 1):
        if n == 1 or text[:n] in words:
            out += [(text[:n], *rest) for rest in brute(text[n:], words, score)]
    return out


def test_cuts():
    s = Segmenter(["甲乙", "甲乙丙", "丙丁"], ["丁戊"])
    assert s.cut("甲乙丙丁戊 ab_1，x") == ["甲乙丙", "丁戊", "ab_1", "，", "x"] and s.cut(None) is None and s.cut("") == s.cut(" 　") == []
    assert Segmenter([]).cut("甲乙é") == ["甲", "乙", "é"]
    assert Segmenter({"甲乙": 50, "甲乙丙": 1, "丙丁": 50}, method="likely").cut("甲乙丙丁") == ["甲乙", "丙丁"]
    rng = random.Random(1)
    words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))): rng.randint(1, 90) for _ in range(12)}
    own, total = Segmenter(words, method="likely"), sum(words.values())
    for _ in range(60):
        t = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 8)))
        score = lambda c: sum(np.log(words.get(w, 0.5) / total) for w in c)
        assert score(own.cut(t)) == pytest.approx(max(map(score, brute(t, words, score))))
    assert len(own.cut("甲乙丙丁" * 30_000)) > 10_000
    with pytest.raises(ValueError):
        Segmenter([], method="x")


def test_words_of_files_and_columns(spark, tmp_path):
    (tmp_path / "w.txt").write_text("甲乙 7 n\n\n丙丁\n甲乙 3\n", encoding="utf-8")
    words = read_words(spark, str(tmp_path / "w.txt"))
    assert words == {"甲乙": 7, "丙丁": 1}
    df = spark.createDataFrame([(0, "甲乙<b>丙丁"), (1, None), (2, "")], "row_id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r["row_id"]: r["tokens"] for r in pipeline.tokens(df, ["丙丁"], Segmenter(words)).collect()}
    assert got == {0: ["甲乙"], 1: None, 2: []} and pipeline.tokens(df.where("false"), None, Segmenter(words)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    rows = [(i, "甲乙丙 新闻" if i % 2 else "丁戊己 消息", "体育" if i % 2 else "财经") for i in range(40)]
    for name in ("train", "val"):
        spark.createDataFrame(rows, "row_id long, text string, y string").write.parquet(str(tmp_path / name))
    (tmp_path / "w.txt").write_text("甲乙\n丁戊\n", encoding="utf-8")
    own = ["--model", str(tmp_path / "m")]
    main(["train", "--train", str(tmp_path / "train"), "--val", str(tmp_path / "val"), "--words", str(tmp_path / "w.txt"), "--models", "naive_bayes", "knn", "--size", "3", *own], spark)
    main(["evaluate", "--table", f"val={tmp_path / 'val'}", *own], spark)
    main(["predict", "甲乙丙 新闻", *own], spark)
    out = capsys.readouterr().out
    assert "macro_f1" in out and out.strip().endswith("体育")


def test_reports(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, v.tolist(), int(v[5] > 0)) for i, v in enumerate(x)], "row_id long, x array<double>, y int")
    got = reduce.compared_with_ml(df, 3).toPandas()
    assert len(got) == 3 and got["max_diff"].max() < 1e-8
    assert all(abs(r["value"]) < 1e-8 or r["property"] == "variance" and abs(r["value"] - np.cov(x.T).trace()) < 1e-8 for r in reduce.properties(df, 2).collect())
    table = pipeline.compared({"naive_bayes": {}, "decision_tree": {"max_depth": 2}}, {"train": df, "val": df.where("row_id < 50")}).collect()
    assert {(r["model"], r["split"]) for r in table} == {(m, s) for m in ("naive_bayes", "decision_tree") for s in ("train", "val")} and all(r["seconds"] > 0 for r in table)
    both = corpus.together({"a": df, "b": df.where("row_id < 2")})
    assert corpus.first_rows(both, 3).count() == 5 and df.select(corpus.shortened(F.lit("甲乙丙"), 2)).first()[0] == "甲乙..."
