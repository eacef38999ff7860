import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wenloom import queries
from wenloom.operators import corpus, encoder, ensemble, metrics, models, reduce, search, store, terms, trees
from wenloom.plans import pipeline
from wenloom.sources import sinks


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        y = "abc"[i % 3]
        center = {"a": [3, 0], "b": [0, 3], "c": [-3, -3]}[y]
        rows.append((i, [float(v) for v in rng.normal(center, 0.7)], y))
    return spark.createDataFrame(rows, "row_id long, x array<double>, y string")


def test_metrics_goldens(spark):
    labels = ["a", "b", "c", "d", "e"]
    rows = [(y, "a" if y == "e" else y, "a") for y in labels for _ in range(20)]
    df = spark.createDataFrame(rows, "y string, A string, B string")
    long = df.select("y", F.lit("A").alias("model"), F.col("A").alias("p")).unionByName(df.select("y", F.lit("B").alias("model"), F.col("B").alias("p")))
    got = {r["model"]: r for r in metrics.model_metrics(long, ["model"]).collect()}
    assert (round(got["A"]["accuracy"], 6), round(got["A"]["macro_f1"], 6), round(got["A"]["weighted_f1"], 6)) == (0.8, 0.733333, 0.733333)
    assert (round(got["B"]["macro_precision"], 6), round(got["B"]["macro_f1"], 6)) == (0.04, 0.066667)
    pairs = metrics.pair_counts(long.where("model = 'A'"))
    by = {r["average"]: r for r in metrics.averages(metrics.per_class(pairs)).collect()}
    assert round(by["macro_of_means"]["f1"], 6) == 0.746667
    assert metrics.confusion_matrix(pairs).agg(F.sum("n")).first()[0] == 100
    assert "accuracy" in metrics.formatted(metrics.classification_report(pairs))
    assert metrics.model_metrics(long.where("false"), ["model"]).count() == 0


def test_folds_samples_and_draws(spark):
    df = spark.range(11).withColumnRenamed("id", "row_id")
    sizes = [r["count"] for r in corpus.kfold(df, 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 2, 2, 2, 2]
    assert corpus.kfold(df.where("false")).count() == 0
    own = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") < 990, 2).alias("label_id"))
    counts = {r["label_id"]: r["count"] for r in corpus.stratified_sample(own, 50).groupBy("label_id").count().collect()}
    assert counts == {1: 50, 2: 50}
    assert corpus.stratified_sample(own, None).count() == 1000
    boot = corpus.bootstrap(df, 3).groupBy("tree").agg(F.sum("times").alias("n")).collect()
    assert sorted(r["n"] for r in boot) == [11, 11, 11]
    assert [r["count"] for r in corpus.row_subsample(df, 0.5, 2).groupBy("grp").count().collect()] == [5, 5]


def test_read_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\t0\nx\t1\nx\t42\nx\tabc\nx\ty\t0\nx\n\nx\t\n é\xff\t3 \n".encode("latin-1").replace(b"\xe9", "é".encode()))
    rows = {(r["text"], r["label_id"]) for r in corpus.read_tsv(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {("x", 0), ("x", 1), ("x", 42), ("é", 3)}


def test_scaling_pca_and_fusion(spark):
    df = spark.createDataFrame([(i, [v, 5.0]) for i, v in enumerate((1.0, 2.0, 4.0))], "row_id long, x array<double>")
    s = reduce.fit_scaler(df)
    assert round(s.scale[0], 6) == 1.247219 and s.scale[1] == 1.0
    assert all(r["x"][1] == 0 for r in s.transform(df).collect())
    with pytest.raises(ValueError):
        reduce.fit_scaler(df, kind="other")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").union(spark.createDataFrame([(99, None)], "row_id long, x array<double>"))
    p = reduce.fit_pca(rows, 5)
    s2 = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(p.variance, s2 / 59) and np.allclose(p.ratio, s2 / s2.sum()) and np.allclose(p.components @ p.components.T, np.eye(5))
    back = p.inverse(p.transform(rows, out="z"), "z", "b").where("x is not null").collect()
    assert all(np.allclose(r["x"], r["b"]) for r in back)
    coo = rows.where("x is not null").select("row_id", F.posexplode("x").alias("idx", "value"))
    q = reduce.fit_sparse_pca(reduce.sparse_rows(coo), 60, 5, 3)
    assert np.allclose(q.variance, p.variance[:3]) and np.allclose(q.components, p.components[:3], atol=1e-6)
    grid = reduce.weight_grid(spark, 0.1)
    assert grid.count() == 66 and reduce.weight_grid(spark, 0.5).count() == 6
    short = rows.where("x is not null").select("row_id", F.slice("x", 1, 2).alias("x"))
    fused = reduce.fuse({"a": rows.where("x is not null"), "b": short}, {"a": 1.0, "b": 2.0}, "pad").where("row_id = 0").first()["x"]
    assert np.allclose(fused, x[0] + 2 * np.r_[x[0][:2], 0, 0, 0])


def test_idf_and_pooling(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(("甲 乙", "甲", "甲"))], "row_id long, text string")
    m = terms.Tfidf(min_df=1, max_df=1.0, high=1).fit(docs)
    assert {r["term"]: round(r["idf"], 6) for r in m.vocab.collect()} == {"甲": 1.0, "乙": 1.693147}
    norms = m.transform(docs).groupBy("row_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(math.isclose(r["n"], 1) for r in norms)
    tokens = spark.createDataFrame([(1, "x", 1), (1, "oov", 1)], "row_id long, word string, tf long")
    vec = spark.createDataFrame([("x", 0, 2.0)], "word string, idx int, x double")
    assert terms.pooled(tokens, vec, spark.createDataFrame([], "term string, idf double")).first()["value"] == 2.0


def test_tree_goldens(spark):
    df = spark.createDataFrame([(i, [float(v)], y) for i, (v, y) in enumerate(zip((1, 2, 3, 4), "aabb"))], "row_id long, x array<double>, y string")
    t = models.DecisionTree().fit(df).tree
    assert (t.nodes[1].feature, t.nodes[1].threshold) == (0, 2.0) and len(t.nodes) == 3
    flat = df.select(F.lit(1).alias("node"), F.lit(1.0).alias("w"), F.when(F.col("y") == "a", -1.0).otherwise(1.0).alias("g"), F.lit(0.5).alias("h"), F.posexplode("x").alias("idx", "value"))
    best = trees.best_splits(flat, ["node"], trees.Gradient()).first()
    assert best["value"] == 2.0 and math.isclose(best["gain"], 2.0)
    one = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "b"), (2, None, "a")], "row_id long, x array<double>, y string")
    assert len(models.DecisionTree().fit(one).tree.nodes) == 1
    r = models.RegressionTree().fit(df.withColumn("t", F.col("row_id").cast("double")))
    assert np.allclose(r.walk(np.array([[1.0], [4.0]])), [0, 3])
    assert np.allclose([x[0] for x in df.orderBy("row_id").select(trees.predict_column([r], F.col("x"))).collect()], [[0], [1], [2], [3]])


def test_tree_matches_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (80, 4)).astype(float), rng.integers(0, 3, 80)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, x array<double>, y int")
    gini = lambda c: 1 - sum((np.sum(c == k) / len(c)) ** 2 for k in range(3))
    best = (0, -1, 0)
    for j in range(4):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            g = round(gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left]), 12)
            if g > best[0]:
                best = (g, j, t)
    root = models.DecisionTree(max_depth=1).fit(df).tree.nodes[1]
    assert (root.feature, root.threshold) == best[1:]


@pytest.mark.parametrize("name,own", [("naive_bayes", {}), ("svm", {"epochs": 10, "rate": 0.1}), ("knn", {}), ("logistic_regression", {"steps": 20, "rate": 0.5}), ("random_forest", {"n_trees": 3, "max_depth": 3}), ("gbdt", {"n_rounds": 2, "rate": 0.5}), ("xgboost", {"n_rounds": 2, "max_depth": 2, "rate": 0.5}), ("lightgbm", {"n_rounds": 1, "max_depth": 2}), ("decision_tree", {"max_depth": 3, "bins": 16})])
def test_models_learn(spark, blobs, name, own, tmp_path):
    fitted = models.base_model(name, **own).fit(blobs.where("row_id % 5 < 4"))
    out = fitted.transform(blobs.where("row_id % 5 = 4")).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out if name != "svm")
    assert sum(r["p"] == r["y"] for r in out) >= (0.5 if name == "naive_bayes" else 0.8) * len(out)
    store.save(spark, fitted, str(tmp_path / "m"))
    again = store.load(spark, str(tmp_path / "m")).transform(blobs).select("row_id", "p").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in fitted.transform(blobs).select("row_id", "p").collect()}
    losses = getattr(fitted, "losses", [])
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def test_bayes_priors_and_batch_shift(spark, blobs):
    rows = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [0.0, 3.0], "b"), (2, [1.0, 1.0], "b")], "row_id long, x array<double>, y string")
    m = models.NaiveBayes().fit(rows)
    assert np.allclose(np.exp(m.log_prior), [1 / 3, 2 / 3])
    assert m.transform(rows, "batch").count() == 3
    with pytest.raises(ValueError):
        m.transform(rows, "other")
    with pytest.raises(ValueError):
        models.base_model("nothing")


def test_zero_margin_votes_for_none(spark):
    m = models.SvmModel(["a", "b"], [(0, 1)], np.zeros((1, 2)), np.zeros(1))
    df = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    assert df.select(m.votes(F.col("x"))).first()[0] == [0.0, 0.0]


def test_softmax_gradient(spark, blobs):
    rows, labels = models.prepared(blobs)
    w, b = np.full((3, 2), 0.1), np.array([0.0, 0.1, 0.2])
    gw, gb, loss = models.softmax_gradient(rows.repartition(3), w, b)
    local = rows.collect()
    x, y = np.array([r["x"] for r in local]), np.array([r["y"] for r in local])
    z = x @ w.T + b
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    e = p - np.eye(3)[y]
    assert np.allclose(gw, e.T @ x / len(x)) and np.allclose(gb, e.mean(0)) and math.isclose(loss, -np.log(p[np.arange(len(y)), y]).mean(), rel_tol=1e-6)
    assert labels == ["a", "b", "c"]


def test_votes(spark):
    w = ensemble.vote_weights(spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.5)], "model string, f1 double"))
    assert {r["model"]: round(r["weight"], 6) for r in w.collect()} == {"a": 0.45, "b": 0.3, "c": 0.25}
    zero = ensemble.vote_weights(spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model string, f1 double"))
    assert [r["weight"] for r in zero.collect()] == [0.5, 0.5]
    tie = spark.createDataFrame([(1, "m", "b"), (1, "n", "a")], "row_id long, model string, p string")
    assert ensemble.hard_vote(tie).first()["p"] == "a"


def test_encoder_block(spark):
    c = encoder.EncoderConfig(vocab=20, width=8, layers=1, heads=2, inner=16, length=16)
    w = encoder.load_weights(c, "/nowhere.npz")
    ids, mask = np.array([[1, 2, 3, 0]]), np.array([[1, 1, 1, 0]])
    long, _ = encoder.forward(ids, mask, w, c)
    short, pooled = encoder.forward(ids[:, :3], mask[:, :3], w, c)
    assert np.allclose(long[:, :3], short, atol=1e-5) and pooled.shape == (1, 8)
    df = spark.createDataFrame([(1, "甲乙"), (2, None), (3, "甲" * 50)], "row_id long, text string")
    rows = encoder.encoded(df, w, c, encoder.vocabulary_map({"甲": 3}), batch=2).collect()
    assert len(rows) == 3 and all(np.isfinite(r["x"]).all() for r in rows)


def test_encoder_computes_equal_texts_once_and_in_the_weights_precision(spark):
    c = encoder.EncoderConfig(vocab=40, width=8, layers=2, heads=2, inner=16, length=12)
    w = encoder.random_weights(c)
    vocab = {ch: 5 + i for i, ch in enumerate("甲乙丙丁abc")}
    texts = ["甲乙", "甲乙", None, "", "丙" * 30, "a丁c", "甲乙", "a丁c", None, "b"]
    df = spark.createDataFrame([(i, texts[i % 10]) for i in range(200)], "row_id long, text string").repartition(7)
    hidden, pool = zip(*(encoder.forward(np.array([ids]), np.ones((1, len(ids)), int), w, c) for ids in (encoder.ids_of(t, vocab, c.length) for t in texts)))
    assert hidden[0].dtype == np.float32 and pool[0].dtype == np.float32
    for pooled, want in ((False, [h[0, 0] for h in hidden]), (True, [p[0] for p in pool])):
        for own in (vocab, encoder.vocabulary_map(vocab)):
            got = {r["row_id"]: r["x"] for r in encoder.encoded(df, w, c, own, pooled, batch=2).collect()}
            assert len(got) == 200 and all(np.allclose(got[i], want[i % 10], atol=1e-5) for i in got)
            assert len({tuple(got[i]) for i in range(0, 200, 10)}) == 1
    short, _ = encoder.forward(np.array([[1, 2, 3, 0]]), np.array([[1, 1, 1, 0]]), w, c, first=True)
    whole, _ = encoder.forward(np.array([[1, 2, 3]]), np.ones((1, 3), int), w, c)
    assert short.shape == (1, 1, 8) and np.allclose(short[:, 0], whole[:, 0], atol=1e-5)


def test_pipeline(spark, tmp_path):
    words = {"体育": ["球队", "进球", "裁判"], "财经": ["银行", "利率", "贷款"]}
    rows = [(i, " ".join(words[y][(i + j) % 3] for j in range(3)) + f" 词{i % 4}", y) for i in range(60) for y in (list(words)[i % 2],)]
    df = spark.createDataFrame(rows, "row_id long, text string, y string")
    fit = pipeline.train(df.where("row_id < 48"), df.where("row_id >= 48"), {"naive_bayes": {}, "logistic_regression": {"steps": 5, "rate": 0.5}}, ["词"], pipeline.Features(size=4), 2, models.SoftmaxRegression(rate=0.5, steps=5))
    assert fit.predict_text(spark, "银行 贷款 利率") == "财经" and fit.predict_text(spark, "裁判 进球") == "体育"
    assert fit.evaluate({"val": df.where("row_id >= 48")}, "stacking").first()["accuracy"] == 1.0
    fit.save(spark, str(tmp_path / "f"))
    loaded = pipeline.Classifier.load(spark, str(tmp_path / "f"))
    assert loaded.predict_text(spark, "裁判 进球", "stacking") == "体育"
    again = loaded.features
    own = pipeline.tokens(df.limit(3), ["词"]).select("row_id", "tokens")
    a, b = ({r["row_id"]: r["x"] for r in f.transform(own).collect()} for f in (fit.features, again))
    assert all(np.allclose(a[k], b[k]) for k in a)
    (tmp_path / "stop.txt").write_text("的\n\n 的 \n了\n", encoding="utf-8")
    assert pipeline.stopwords(spark, str(tmp_path / "stop.txt")) == ["了", "的"] and pipeline.stopwords(spark, str(tmp_path / "none.txt")) == []


def test_weight_search(spark, blobs, tmp_path):
    fam = {n: blobs.select("row_id", "x") for n in ("tfidf", "word2vec", "bert")}
    found = pipeline.optimise(spark, fam, fam, blobs.select("row_id", "y"), 0.5, str(tmp_path))
    assert found.count() == 6 and search.ranked(found).first()["f1_macro"] > 0.9
    doc = json.loads(spark.read.text(f"{tmp_path}/weights").first()[0])
    assert set(doc) == {"best_weights", "best_f1_macro", "all_results"} and len(doc["all_results"]) == 6
    assert spark.read.parquet(f"{tmp_path}/fused").where("split = 'val'").count() == 150
    assert search.cross_validate(blobs, 3).count() == 3
    own = blobs.withColumn("split", F.lit("train"))
    sinks.write_by_split(own, str(tmp_path / "s"), {"weights": [0.2]})
    assert sinks.read_by_split(spark, str(tmp_path / "s"), "train").count() == 150 and sinks.read_about(spark, str(tmp_path / "s")) == {"weights": [0.2]}


def test_streamed_scores(spark, blobs, tmp_path):
    from wenloom.streaming.score import score_stream

    blobs.write.parquet(str(tmp_path / "in"))
    m = models.NaiveBayes().fit(blobs)
    score_stream(spark.readStream.schema(blobs.schema).parquet(str(tmp_path / "in")), m, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 150


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    """A folder with vectors of 64 dimensions, whose last one tells the ten labels apart."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 64))
    x[:, 63] = np.arange(200) // 10 % 10 * 5 + rng.normal(0, 0.1, 200)
    d = str(tmp_path_factory.mktemp("emb"))
    spark.createDataFrame([(i, v.tolist(), i // 10 % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


class Watched(Exception):
    pass


@pytest.mark.parametrize("name", ["decision_tree", "forest", "gbdt", "xgb", "lgbm", "svm", "lr"])
def test_model_queries_fit_on_everything(spark, embeddings, monkeypatch, name):
    made = []

    def fit(self, df):
        made.append((self, df))
        raise Watched

    kinds = [models.DecisionTree, models.RandomForest, models.Boosting, models.PairwiseSvm, models.SoftmaxRegression]
    for kind in kinds:
        monkeypatch.setattr(kind, "fit", fit)
    with pytest.raises(Watched):
        queries.queries()[f"{name}_predict"](spark, embeddings)
    model, df = made[0]
    default = {"forest": "random_forest", "xgb": "xgboost", "lgbm": "lightgbm", "lr": "logistic_regression"}.get(name, name)
    assert model == models.base_model(default)
    assert df.agg(F.min(F.size("x")), F.countDistinct("y")).first()[:] == (64, 10)


def test_searches_take_everything(spark, embeddings, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "logistic", lambda a, b: seen.append((len(a.first()["x"]), a.select("y").distinct().count())) or b.select("row_id", "y", F.col("y").alias("p")))
    assert queries.queries()["weight_search"](spark, embeddings).count() == 66 and queries.queries()["cv_scores"](spark, embeddings).count() == 5
    assert set(seen) == {(64, 10)} and len(seen) == 71


@pytest.mark.parametrize("name,own", [("decision_tree", {"max_depth": 3}), ("random_forest", {"n_trees": 4, "max_depth": 3}), ("gbdt", {"n_rounds": 2, "max_depth": 2}), ("svm", {"epochs": 5, "rate": 0.1}), ("logistic_regression", {"steps": 5, "rate": 0.5})])
def test_small_models(spark, embeddings, name, own):
    rows = queries._emb(spark, embeddings).select("row_id", F.slice("x", 57, 8).alias("x"), (F.col("y") % 3).alias("y"))
    got = models.base_model(name, **own).fit(rows).transform(rows)
    assert got.where("p between 0 and 2").count() == 200


def test_stacking_queries_keep_all_labels(spark, embeddings):
    assert {r[0] for r in queries.queries()["oof_layout"](spark, embeddings).select(F.size("x")).collect()} == {20}


def test_encoder_takes_all_splits_and_characters(spark, tmp_path):
    texts = {"train": ["的" * 40 + "甲", "龘x", None], "dev": ["的" * 40 + "乙"], "test": ["丙" * 200]}
    for i, (n, own) in enumerate(texts.items()):
        spark.createDataFrame([(10 * i + j, t) for j, t in enumerate(own)], "row_id long, text string").write.parquet(f"{tmp_path}/{n}.parquet")
    got = {r["row_id"]: r for r in queries._encoded(spark, str(tmp_path)).collect()}
    joined = {r["row_id"]: r["ids"] for r in queries.queries()["char_encode"](spark, str(tmp_path)).collect()}
    assert joined == {k: ",".join(map(str, r["ids"])) for k, r in got.items()}
    assert set(got) == {0, 1, 2, 10, 20} and all(len(r["ids"]) == len(r["mask"]) == 128 and 100 not in r["ids"] for r in got.values())
    assert sum(got[0]["mask"]) == 43 and got[0]["ids"] != got[10]["ids"] and sum(got[20]["mask"]) == 128
    vocab = {c: 200 + i for i, c in enumerate("x的甲乙丙龘")}
    df = spark.createDataFrame([(0, "的甲?"), (1, None), (2, "丙" * 200)], "row_id long, text string")
    column = df.select("row_id", encoder.encode_characters(F.col("text"), encoder.vocabulary_map(vocab)).alias("e")).select("row_id", "e.*").orderBy("row_id").collect()
    assert column == encoder.character_ids(df, vocab).orderBy("row_id").collect()
    x = {r["row_id"]: r["x"] for r in queries.queries()["encoder_vectors"](spark, str(tmp_path)).collect()}
    assert set(x) == set(got) and not np.allclose(x[0], x[10], atol=1e-6)


def test_whole_splits_and_covariance(spark, embeddings):
    rows = spark.read.parquet(f"{embeddings}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r["embedding"] for r in rows], np.float64), np.array([r["label"] for r in rows])
    run = lambda name: queries.queries()[name](spark, embeddings)
    got = {(r["i"], r["j"]): r["cov"] for r in run("covariance").collect()}
    c = np.cov(x.T)
    assert set(got) == {(i, j) for i in range(64) for j in range(i, 64)} and all(abs(v - c[k]) < 1e-6 for k, v in got.items())

    def gini(k):
        return 1 - sum((np.mean(y[k] == v) ** 2) for v in range(10))

    def score(left):
        g, h = 0.1 - (y == 0), np.full(len(y), 0.09)
        part = lambda k: g[k].sum() ** 2 / (h[k].sum() + 1)
        allowed = min(h[left].sum(), h[~left].sum()) >= 1
        n = left.mean()
        return (
            gini(np.full(len(y), True)) - n * gini(left) - (1 - n) * gini(~left),
            y.var() - n * y[left].var() - (1 - n) * y[~left].var(),
            0.5 * (part(left) + part(~left) - part(np.full(len(y), True))) if allowed else -np.inf,
        )

    gains = np.full((3, 64), -np.inf)
    for j in range(64):
        for t in np.unique(x[:, j])[:-1]:
            gains[:, j] = np.maximum(gains[:, j], score(x[:, j] <= t))
    for i, name in enumerate(("gini", "mse", "xgb")):
        best = run(f"best_split_{name}").collect()
        assert len(best) == 1 and best[0]["idx"] == gains[i].argmax() == 63 and abs(best[0]["gain"] - gains[i].max()) < 1e-5
    own = {r["idx"]: r["gain"] for r in run("xgb_split_gain").collect()}
    assert len(own) == 64 and all(abs(own[j] - gains[2, j]) < 1e-5 for j in own)


def test_pipeline_has_the_encoder_family(spark, tmp_path):
    rows = [(i, [f"甲{'乙丙丁戊'[i % 4]}", "己庚辛"[i % 3], "壬"]) for i in range(40)] + [(90, None)]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    c = encoder.EncoderConfig(vocab=300, width=128, layers=2, heads=2, inner=512)
    np.savez(tmp_path / "w.npz", **encoder.random_weights(c, 7))
    f = pipeline.Features(size=3, bert=c, encoder_path=str(tmp_path / "w.npz")).fit(df)
    assert np.allclose(f.bert_weights["word"], encoder.random_weights(c, 7)["word"]) and f.weights == {"tfidf": 0.2, "word2vec": 0.3, "bert": 0.5} and set(f.scalers) == set(f.weights)
    parts = {n: {r["row_id"]: np.array(r["x"]) for r in f.scalers[n].transform(x).collect()} for n, x in f._families(df).items()}
    fused = {r["row_id"]: np.array(r["x"]) for r in f.transform(df).collect()}
    assert len(fused) == 41 and all(np.allclose(fused[k], sum(w * parts[n][k] for n, w in f.weights.items())) for k in fused)
    assert any(np.abs(parts["bert"][k]).max() > 0.1 for k in fused)
    f.save(spark, str(tmp_path / "f"))
    again = {r["row_id"]: r["x"] for r in pipeline.Features.load(spark, str(tmp_path / "f")).transform(df).collect()}
    assert all(np.allclose(fused[k], again[k]) for k in fused)
    assert set(pipeline.Features(size=3).weights) == {"tfidf", "word2vec"}
    with pytest.raises(ValueError):
        pipeline.Features(size=3, bert=c, encoder_path=str(tmp_path / "none.npz")).fit(df)
