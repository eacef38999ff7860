import math

import numpy as np
from pyspark.sql import functions as F

from wenloom.functions import text as X
from wenloom.functions import vectors as V
from wenloom.operators.encoder import vocabulary_map


def test_cleaning(spark):
    cases = {
        "<b>hi</b>": "hi", "a　　b c": "a b c", "中foo@bar.com": "中foo@bar.com", "mail foo@bar.com now": "mail now", "https://m.x.net/en/25#top": "#top",
        "see http://x.cn/~u ok": "see ~u ok", "see http://x.cn/a?b=1 ok": "see ok", "": "", None: None, "http://" + "a" * 200_000: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.select("t", "want", X.clean_text(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r["t"][:30]


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([("Aé b_1",), ("",), (None,)], "t string")
    rows = df.select(X.words(F.col("t")).alias("w"), X.ngrams(X.words(F.col("t"))).alias("g")).collect()
    assert rows[0]["w"] == ["aé", "b_1"] and rows[0]["g"] == ["aé", "b_1", "aé b_1"]
    assert rows[1]["g"] == [] and rows[2]["g"] is None
    stop = spark.createDataFrame([(["a", "A", "b", " ", "b"],)], "t array<string>").select(X.without_stopwords(F.col("t"), ["a"]).alias("t")).first()
    assert stop["t"] == ["A", "b", "b"]


def test_character_ids(spark):
    df = spark.createDataFrame([("",), (None,), ("甲" * 200,), ("甲乙",)], "t string")
    rows = df.select(X.encode_characters(F.col("t"), vocabulary_map({"甲": 7}), 128).alias("e")).collect()
    for r in rows[:2]:
        assert r["e"]["ids"] == [101, 102] + [0] * 126 and r["e"]["mask"] == [1, 1] + [0] * 126
    assert len(rows[2]["e"]["ids"]) == 128 and 102 not in rows[2]["e"]["ids"] and all(rows[2]["e"]["mask"])
    assert rows[3]["e"]["ids"][:5] == [101, 7, 100, 102, 0]


def test_vectors(spark):
    x, y = np.array([1.0, -2.0, 3.0]), np.array([0.5, 0.0, 2.0])
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    r = df.select(
        V.dot(F.col("x"), F.col("y")).alias("dot"), V.cosine(F.col("x"), F.col("y")).alias("cos"), V.softmax(F.col("x")).alias("soft"), V.layer_norm(F.col("x")).alias("ln"),
        V.gelu(F.lit(1.0)).alias("gelu"), V.argmax(F.col("x")).alias("top"), V.one_hot(F.lit("b"), ["a", "b"]).alias("hot"),
    ).first()
    assert math.isclose(r["dot"], x @ y) and math.isclose(r["cos"], x @ y / np.linalg.norm(x) / np.linalg.norm(y), rel_tol=1e-8)
    assert np.allclose(r["soft"], np.exp(x) / np.exp(x).sum()) and np.allclose(r["ln"], (x - x.mean()) / x.std())
    assert abs(r["gelu"] - 0.841192) < 1e-6 and r["top"] == 2 and r["hot"] == [0.0, 1.0]
