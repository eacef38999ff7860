import numpy as np
import pytest
from pyspark.sql import functions as F

from wenloom.operators import growth, models, terms, trees
from wenloom.operators.models import Boosting, DecisionTree, PairwiseSvm, RandomForest, RegressionTree, SoftmaxRegression


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 5)), 2)
    y = (x[:, 2] > 0.3).astype(int) + (x[:, 4] > 0.5)
    rows = [(i, v.tolist(), int(c), float(v[0] + c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y int, t double").repartition(5)


def nodes(tree):
    return {i: (n.feature, n.threshold, round(float(n.value), 9)) for i, n in tree.nodes.items()}


def same(a, b):
    return all(nodes(s) == nodes(t) for s, t in zip(a, b, strict=True))


def test_bins_give_exact_trees_where_values_fit(data):
    assert same([DecisionTree(max_depth=4).fit(data).tree], [DecisionTree(max_depth=4, bins=None).fit(data).tree])
    assert same([RegressionTree(max_depth=3, min_leaf=5).fit(data)], [RegressionTree(max_depth=3, min_leaf=5, bins=None).fit(data)])
    own = {"n_trees": 3, "max_depth": 3, "max_features": 2}
    assert same(RandomForest(**own).fit(data).grown, RandomForest(bins=None, **own).fit(data).grown)
    for kind in ("residual", "gradient"):
        a, b = (Boosting(n_rounds=2, max_depth=2, kind=kind, bins=n).fit(data) for n in (growth.BINS, None))
        assert same([t for r in a.rounds for t in r], [t for r in b.rounds for t in r]) and np.allclose(a.losses, b.losses)


def test_sorted_rows_and_histograms_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[::7, 2] = np.nan
    w, hit = np.ones(300), rng.random(300) > 0.5
    for criterion, stats in ((trees.Variance(), [w, rng.normal(size=300)]), (trees.Gradient(), [w, rng.normal(size=300), rng.random(300)]), (trees.Gini(2), [hit, ~hit])):
        own = growth.local_edges(x, 40)
        grown = []
        for share in (0, 2, 1_000):
            monkeypatch.setattr(growth, "SORTED_SHARE", share)
            for allowed in (None, np.array([4, 1, 2])):
                grown.append(growth.grow_here(growth.coded(x, own), np.stack(stats, axis=1).astype(float), own, growth.Shape(own), criterion, None, 4, 2, allowed))
        for (a, u), (b, v) in zip(grown[:2] * 2, grown[2:], strict=True):
            assert same([a], [b]) and np.allclose(u, v) and len(a.nodes) > 20


def test_trees_may_be_deeper_than_an_integer_has_bits(spark, data, tmp_path):
    # Each split takes off the largest target.
    steps = spark.createDataFrame([(i, [float(i)], 3.0**i) for i in range(75)], "row_id long, x array<double>, t double")
    tree = RegressionTree(max_depth=None).fit(steps)
    assert max(tree.nodes).bit_length() > 64
    trees.save(spark, {0: tree}, str(tmp_path / "t"))
    assert same([tree], [trees.load(spark, str(tmp_path / "t"))[0][0]])
    x = np.arange(75.0)[:, None]
    own = growth.local_edges(x, growth.BINS)
    assert np.allclose(growth.leaf_values(tree, growth.coded(x, own), own), tree.walk(x)) and np.allclose(tree.walk(x), 3.0 ** np.arange(75))


def test_partitions_and_one_task_grow_the_same(data, monkeypatch):
    fits = [
        lambda: [DecisionTree(max_depth=4).fit(data).tree],
        lambda: [RegressionTree(min_leaf=7).fit(data)],
        lambda: RandomForest(n_trees=3, max_depth=3).fit(data).grown,
        lambda: [t for r in Boosting(n_rounds=3, max_depth=2).fit(data).rounds for t in r],
        lambda: [t for r in Boosting(n_rounds=2, kind="gradient").fit(data).rounds for t in r],
    ]
    here = [f() for f in fits]
    line = SoftmaxRegression(steps=5).fit(data)
    monkeypatch.setattr(growth, "LOCAL_CELLS", 0)
    monkeypatch.setattr(growth, "BLOCK", 2)
    monkeypatch.setattr(growth, "KEEP", 2)
    assert all(same(a, f()) for a, f in zip(here, fits))
    assert np.allclose(line.weights, SoftmaxRegression(steps=5).fit(data).weights)
    part = Boosting(n_rounds=2, max_depth=2, subsample=0.5).fit(data)
    assert len(part.rounds) == 2 and part.losses[1] < part.losses[0]


def test_few_bins_are_near_the_exact_tree(data):
    few = DecisionTree(max_depth=4, bins=32).fit(data)
    hit = few.transform(data).where("p = y").count()
    assert hit >= 225 and DecisionTree().fit(data).transform(data).where("p = y").count() == 240


def test_odd_values_and_empty_tables(spark, data):
    odd = data.unionByName(spark.createDataFrame([(900 + i, v, 1, 1.0) for i, v in enumerate(([float("nan")] * 5, None, [1.0] * 5))], data.schema))
    model = DecisionTree(max_depth=3).fit(odd)
    got = {r["row_id"]: r["p"] for r in model.transform(odd).collect()}
    assert got[901] is None and got[900] is not None
    many = [trees.Tree({1: trees.Node(1.0)})] * (trees.MAX_CASE_NODES + 1)
    for own in (many, many[:2]):
        assert odd.where("x is null").select(trees.predict_column(own, F.col("x")).alias("v")).first()["v"] is None
    with pytest.raises(ValueError):
        RegressionTree().fit(data.where("false"))
    one = DecisionTree().fit(data.where("y = 1"))
    assert list(one.tree.nodes) == [1]


def test_svm_does_not_depend_on_partitions(data):
    own = {"epochs": 20, "rate": 0.05, "shard_rows": 70, "rounds": 3}
    fitted = [PairwiseSvm(**own).fit(data.repartition(n)) for n in (1, 4, 16)]
    assert all(np.allclose(fitted[0].weights, m.weights) and np.allclose(fitted[0].bias, m.bias) for m in fitted)
    # Up to shard_rows rows: one row after another, as written out here.
    rows = sorted(data.collect(), key=lambda r: r["row_id"])
    model = PairwiseSvm(epochs=3, rate=0.05).fit(data)
    for (i, j), w, b in zip(model.pairs, model.weights, model.bias):
        v, c = np.zeros(5), 0.0
        for _ in range(3):
            for r in rows:
                if r["y"] in (i, j):
                    t, x = (1.0 if r["y"] == i else -1.0), np.array(r["x"])
                    hinge = t * (v @ x + c) < 1
                    v = v - 0.05 * (2 / 3 * v - (t * x if hinge else 0))
                    c += 0.05 * t * hinge
        assert np.allclose(v, w) and np.isclose(c, b)


def test_neighbours_by_shards_and_by_sent_rows(data, monkeypatch):
    asks = data.where("row_id % 7 = 0")
    run = lambda: sorted(map(tuple, models.cosine_neighbours(data, asks, 4).select("query_id", "row_id", "rank", F.round("similarity", 9)).collect()))
    sent = run()
    monkeypatch.setattr(models, "SENT_VALUES", 0)
    monkeypatch.setattr(models, "SHARD_ROWS", 50)
    assert run() == sent and len(sent) == 4 * asks.count()
    assert models.cosine_neighbours(data.where("false"), asks).count() == 0


def test_terms_are_numbered_without_a_limit(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j:03d}" for j in range(i % 7, 300, 7))) for i in range(40)], "row_id long, text string").repartition(4)
    whole, some = (terms.Tfidf(max_features=n, low=1, high=1).fit(df) for n in (None, 500))
    a, b = ({r["term"]: (r["idx"], round(r["idf"], 9)) for r in m.vocab.collect()} for m in (whole, some))
    assert a == b and sorted(i for i, _ in a.values()) == list(range(300)) and some.bounded and not whole.bounded
    rows = lambda m: sorted((r["row_id"], r["idx"], round(r["value"], 9)) for r in m.transform(df).collect())
    assert rows(whole) == rows(some)
