"""The core's queries by name. Their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wenloom.functions import text as X
from wenloom.functions import vectors as V
from wenloom.operators import corpus, encoder, ensemble, metrics, models, reduce, search, terms, trees
from wenloom.operators import segment as segmenting
from wenloom.sources import lines
from wenloom.sources.tables import spread, table

# The classes that the classifiers work on.
SELECTED = ["entertainment", "finance", "education", "sports", "science"]
#: Stop-words of the SQL-checked queries; the operators take any list or file.
STOPWORDS = ["本刊", "讯", "供稿", "版面", "the", "of"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _r(c, digits: int = 6):
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# ---- corpus ---------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.failures(table(spark, d, "train_lines")).select("line_id", "reason")


@query
def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return lines.loaded(table(spark, d, "train_lines")).select("line_id", "text", "label_id")


@query
def load_labeled(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.labeled_lines(table(spark, d, "train_lines").select("line_id", "raw_line"))
    return corpus.labeled(rows, table(spark, d, "class_dim"), selected=True).select("line_id", "text", F.col("name_cn").alias("label"))


@query
def label_dim_join(spark: SparkSession, d: str) -> DataFrame:
    return corpus.labeled(table(spark, d, "train"), table(spark, d, "class_dim")).select("row_id", "label_id", "name", "name_cn")


@query
def filter_selected_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.labeled(table(spark, d, "train"), table(spark, d, "class_dim"))
    return corpus.select_classes(rows, SELECTED).select("row_id", "name")


@query
def three_splits(spark: SparkSession, d: str) -> DataFrame:
    parts = {n: table(spark, d, n).select("row_id", "label_id") for n in ("train", "dev", "test")}
    return corpus.together(parts).groupBy("split", "label_id").agg(F.count(F.lit(1)).alias("n"))


@query
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return corpus.class_distribution(table(spark, d, "train"))


@query
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return corpus.label_index(table(spark, d, "preprocessed_data"), "y")


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_sample(table(spark, d, "train").select("row_id", "label_id"), 200)


@query
def bootstrap_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return corpus.bootstrap(rows, 3)


@query
def row_subsample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"))
    return corpus.row_subsample(rows, 0.5, 3)


@query
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return corpus.kfold(table(spark, d, "train").select("row_id"), 5)


@query
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_split(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- text -----------------------------------------------------------------------


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query
def strip_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("row_id", X.strip_url(F.col("text")).alias("clean"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("row_id", F.array_join(X.words(F.col("text")), "|").alias("tokens"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "preprocessed_data"), 1).select("row_id", "split_name", F.filter("tokens", lambda t: t.isNotNull() & (F.trim(t) != "")).alias("tokens"), "y")


@query
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("row_id", F.array_join(X.without_stopwords(F.col("tokens"), STOPWORDS), "|").alias("tokens"))


@query
def stopword_antijoin(spark: SparkSession, d: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "token string")
    flat = _tokens(spark, d).select("row_id", F.explode("tokens").alias("token"))
    return flat.join(F.broadcast(stop), "token", "left_anti").groupBy("row_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_stats(_tokens(spark, d)).select("split_name", "n", _r(F.col("mean_tokens")).alias("mean_tokens"))


@query
def ngrams_1_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train").select("row_id", F.array_join(X.word_ngrams(F.col("text")), "|").alias("grams"))


def _train_docs(spark: SparkSession, d: str) -> DataFrame:
    """Row and text of training tokens joined by blanks, as the extractors see them."""
    return _tokens(spark, d).where("split_name = 'train'").select("row_id", F.array_join(F.coalesce("tokens", F.array().cast("array<string>")), " ").alias("text"))


def _grams(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(terms.gram_rows(_train_docs(spark, d), "text", "row_id", 1, 2), "grams")


@query
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_df(_grams(spark, d))


@query
def tfidf_vocab(spark: SparkSession, d: str) -> DataFrame:
    return terms.Tfidf().fit(_train_docs(spark, d)).vocab.select("term", "idx", "df", "total")


@query
def idf(spark: SparkSession, d: str) -> DataFrame:
    return terms.Tfidf().fit(_train_docs(spark, d)).vocab.select("term", _r(F.col("idf")).alias("idf"))


@query
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return terms.Tfidf().fit_transform(_train_docs(spark, d))[1].select("row_id", "term", "idx", _r(F.col("value")).alias("value"))


@query
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five heaviest terms of each class."""
    docs = _train_docs(spark, d)
    weights = terms.Tfidf().fit_transform(docs)[1]
    labels = _tokens(spark, d).where("split_name = 'train' and y is not null").select("row_id", "y")
    sums = weights.join(labels, "row_id").groupBy("y", "term").agg(F.sum("value").alias("weight"))
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.desc(F.round("weight", 6)), "term"))
    return sums.withColumn("rank", first).where("rank <= 5").select("y", "rank", "term", _r(F.col("weight"), 4).alias("weight"))


def _word_vector(word):
    """Four numbers from the digest of a word, for checks in two engines."""
    return F.array(*[F.conv(F.substring(F.md5(word), 1 + 4 * i, 4), 16, 10).cast("double") / 65535 for i in range(4)])


@query
def w2v_weighted_pool(spark: SparkSession, d: str) -> DataFrame:
    counts = terms.term_counts(_tokens(spark, d).where("split_name = 'train'"))
    vocab = terms.Tfidf(low=1, high=1).fit(_train_docs(spark, d)).vocab
    known = counts.groupBy("term").agg(F.sum("tf").alias("n")).where("n >= 5").select(F.col("term").alias("word"))
    vectors = known.select("word", F.posexplode(_word_vector(F.col("word"))).alias("idx", "x"))
    return terms.pooled(counts.withColumnRenamed("term", "word"), vectors, vocab).select("row_id", "idx", _r(F.col("value")).alias("value"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Row and text of all three splits."""
    return corpus.together({n: table(spark, d, n).select("row_id", "text") for n in ("train", "dev", "test")}).drop("split")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """At full length, with every character of the corpus."""
    rows = _texts(spark, d)
    return encoder.character_ids(rows, encoder.corpus_vocabulary(rows))


@query
def char_encode(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("row_id", F.array_join("ids", ",").alias("ids"))


@query
def bert_encode(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("row_id", F.array_join("mask", ",").alias("mask"), F.size("ids").alias("length"))


#: Words of the SQL-checked segmentation, longest first.
WORDS = ["内存在", "专家业", "业内人士", "记者", "内存", "存在", "专家", "市民", "网友", "业内", "小时", "分钟", "年度", "票房"]


@query
def segment(spark: SparkSession, d: str) -> DataFrame:
    """Longest words of a dictionary and a user dictionary; ideographs else one by one."""
    cutter = segmenting.Segmenter(WORDS[4:], WORDS[:4])
    return table(spark, d, "train").select("row_id", F.array_join(cutter.column(F.col("text")), "|").alias("tokens"))


# ---- vectors --------------------------------------------------------------------


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = corpus.with_split(_emb(spark, d))
    return rows.where("split = 'train'").drop("split"), rows.where("split <> 'train'").drop("split")


@query
def zscore_fit(spark: SparkSession, d: str) -> DataFrame:
    return reduce.zscore_fit(_emb(spark, d)).select("idx", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


@query
def zscore_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"))
    return reduce.zscore_fit(rows).select("idx", _r(F.col("mean"), 4).alias("mean"), _r(F.col("std"), 4).alias("std"))


@query
def zscore_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = reduce.fit_scaler(_emb(spark, d)).transform(_emb(spark, d))
    return reduce.long_form(rows).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def minmax_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = reduce.fit_scaler(_emb(spark, d), kind="minmax").transform(_emb(spark, d))
    return reduce.long_form(rows).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    fam = {"tfidf": _emb(spark, d).select("row_id", "x"), "word2vec": _emb(spark, d).select("row_id", F.reverse("x").alias("x")), "bert": _emb(spark, d).select("row_id", V.scale(F.col("x"), 2.0).alias("x"))}
    return reduce.long_form(reduce.fuse(fam, {"tfidf": 0.2, "word2vec": 0.3, "bert": 0.5})).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def feature_family_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows that all three families and the labels have, with the vectors' sizes."""
    own = {n: table(spark, d, f).select("row_id", F.size(c).alias(n)) for n, f, c in (("bert", "bert_features_pca_100d", "x_pca"), ("word2vec", "word2vec_features", "x_w2v"), ("fused", "fused_features", "x_fused"))}
    labels = table(spark, d, "preprocessed_data").select("row_id", "split_name", "y")
    return reduce.joined_families(own, labels).select("row_id", "split_name", "y", *[F.when(F.col(n) >= 0, F.col(n)).alias(n) for n in own])


@query
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    return reduce.weight_grid(spark, 0.1)


@query
def top_weights(spark: SparkSession, d: str) -> DataFrame:
    """The ten best triples by a score that any engine can work out."""
    score = F.col("w1") * 0.5 + F.col("w2") * F.col("w3")
    return search.ranked(reduce.weight_grid(spark, 0.1).select("w1", "w2", "w3", _r(score).alias("f1_macro")))


@query
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return reduce.covariance(_emb(spark, d)).select("i", "j", _r(F.col("cov"), 8).alias("cov"))


@query
def pca_transform(spark: SparkSession, d: str) -> DataFrame:
    return reduce.long_form(reduce.fit_pca(_emb(spark, d), 10).transform(_emb(spark, d))).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return reduce.cumulative(spark, reduce.fit_pca(_emb(spark, d), 64).ratio).select("k", _r(F.col("ratio")).alias("ratio"), _r(F.col("cumulative")).alias("cumulative"), "enough")


@query
def cumulative_variance(spark: SparkSession, d: str) -> DataFrame:
    """Share of each dimension's variance, running, with the first that reaches 0.95."""
    import numpy as np

    v = np.array([r["std"] ** 2 for r in reduce.zscore_fit(_emb(spark, d)).orderBy("idx").collect()])
    run = reduce.cumulative(spark, v / v.sum())
    return run.select((F.col("k") - 1).alias("idx"), _r(F.col("cumulative")).alias("cumulative"), "enough")


@query
def reconstruction_mse(spark: SparkSession, d: str) -> DataFrame:
    """Of rounding to two digits, by dimension."""
    rows = _emb(spark, d).withColumn("z", F.transform("x", lambda v: F.floor(v * 100) / 100))
    return reduce.squared_error(rows, "x", "z").select("idx", _r(F.col("mse"), 9).alias("mse"))


@query
def pca_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    fitted = reduce.fit_pca(_emb(spark, d), 32)
    back = fitted.inverse(fitted.transform(_emb(spark, d), out="z"), "z", "back")
    gap = V.mean(F.zip_with("x", "back", lambda a, b: (a - b) * (a - b)))
    return back.agg(_r(F.avg(gap)).alias("mse"))


@query
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of each row and the next one."""
    a, b = _emb(spark, d), _emb(spark, d).select((F.col("row_id") - 1).alias("row_id"), F.col("x").alias("z"))
    return a.join(b, "row_id").select("row_id", _r(V.cosine(F.col("x"), F.col("z"))).alias("cosine"))


@query
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    train, rest = _split(spark, d)
    return models.cosine_neighbours(train, rest, 5).select("query_id", "row_id", "rank", _r(F.col("similarity")).alias("similarity"))


@query
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    train, rest = _split(spark, d)
    return models.neighbour_vote(models.cosine_neighbours(train, rest, 5), train)


@query
def softmax(spark: SparkSession, d: str) -> DataFrame:
    return reduce.long_form(_emb(spark, d).withColumn("x", V.softmax(F.col("x")))).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def gelu(spark: SparkSession, d: str) -> DataFrame:
    return reduce.long_form(_emb(spark, d)).select("row_id", "idx", _r(V.gelu(F.col("value"))).alias("value"))


@query
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    return reduce.long_form(_emb(spark, d).withColumn("x", V.layer_norm(F.col("x")))).select("row_id", "idx", _r(F.col("value")).alias("value"))


@query
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """Of each value and its reversed row's, by dimension."""
    pairs = _emb(spark, d).select(F.posexplode(F.arrays_zip(F.col("x"), F.reverse("x").alias("z"))).alias("idx", "p")).select("idx", F.col("p.x").alias("a"), F.col("p.z").alias("b"))
    own = reduce.differences(pairs, ["idx"])
    return own.select("idx", *[_r(F.col(c)).alias(c) for c in own.columns if c != "idx"])


@query
def pca_properties(spark: SparkSession, d: str) -> DataFrame:
    return reduce.properties(_emb(spark, d), 32).select("property", _r(F.col("value"), 5).alias("value"))


@query
def pca_against_ml(spark: SparkSession, d: str) -> DataFrame:
    """Largest and mean differences to Spark's own PCA, by component."""
    own = reduce.compared_with_ml(_emb(spark, d), 10)
    return own.select("idx", *[_r(F.col(c)).alias(c) for c in ("max_diff", "mean_diff", "corr")])


# ---- models ---------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows with source and the label's index, and the labels by index."""
    rows = table(spark, d, "train").where("label_id is not null")
    index = corpus.label_index(rows, "label_id")
    return rows.join(F.broadcast(index), F.col("label_id") == F.col("label")).select("source", F.col("idx").alias("y"), F.lit(1.0).alias("w")), index


@query
def gini_impurity(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _labelled(spark, d)
    return trees.summary(rows, ["source"], trees.Gini(index.count())).select("source", _r(F.col("impurity")).alias("gini"))


@query
def mse_impurity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.lit(1.0).alias("w"), F.col("l_quantity").cast("double").alias("t"))
    return trees.summary(rows, ["l_returnflag"], trees.Variance()).select("l_returnflag", _r(F.col("impurity"), 4).alias("mse"), _r(F.col("leaf"), 4).alias("leaf"))


@query
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _labelled(spark, d)
    leaves = trees.summary(rows, ["source"], trees.Gini(index.count()))
    return leaves.join(F.broadcast(index), F.col("leaf") == F.col("idx")).select("source", F.col("label").alias("label_id"))


def _flat(spark: SparkSession, d: str, *targets) -> DataFrame:
    return _emb(spark, d).select(F.lit(1.0).alias("w"), *targets, F.posexplode("x").alias("idx", "value"))


def _best(flat: DataFrame, criterion) -> DataFrame:
    return trees.best_splits(flat.withColumn("node", F.lit(1)), ["node"], criterion).select("idx", _r(F.col("value"), 8).alias("threshold"), _r(F.col("gain")).alias("gain"))


@query
def best_split_gini(spark: SparkSession, d: str) -> DataFrame:
    return _best(_flat(spark, d, "y"), trees.Gini(10))


@query
def best_split_mse(spark: SparkSession, d: str) -> DataFrame:
    return _best(_flat(spark, d, F.col("y").cast("double").alias("t")), trees.Variance())


def _gradients(spark: SparkSession, d: str) -> DataFrame:
    """First round of class 0 against a flat start."""
    g = F.lit(0.1) - (F.col("y") == 0).cast("double")
    return _flat(spark, d, g.alias("g"), F.lit(0.09).alias("h"))


@query
def best_split_xgb(spark: SparkSession, d: str) -> DataFrame:
    return _best(_gradients(spark, d), trees.Gradient())


@query
def xgb_split_gain(spark: SparkSession, d: str) -> DataFrame:
    """The best gain of every feature."""
    return _best_gains(_gradients(spark, d))


def _best_gains(flat: DataFrame) -> DataFrame:
    gains = trees.split_gains(flat.withColumn("node", F.lit(1)), ["node"], trees.Gradient())
    return gains.groupBy("idx").agg(_r(F.max("gain")).alias("gain"))


@query
def xgb_leaf_weight(spark: SparkSession, d: str) -> DataFrame:
    g = F.lit(0.1) - (F.col("y") == 0).cast("double")
    rows = _emb(spark, d).select("y", F.lit(1.0).alias("w"), g.alias("g"), F.lit(0.09).alias("h"))
    return trees.summary(rows, ["y"], trees.Gradient()).select("y", _r(F.col("leaf")).alias("weight"))


def _root(tree: trees.Tree) -> list[tuple[int, float]]:
    return [(tree.nodes[1].feature, round(tree.nodes[1].threshold, 8))]


@query
def tree_root_split(spark: SparkSession, d: str) -> DataFrame:
    """The first split of the fitted tree."""
    return spark.createDataFrame(_root(models.DecisionTree(max_depth=1).fit(_emb(spark, d)).tree), "idx int, threshold double")


@query
def xgb_root_split(spark: SparkSession, d: str) -> DataFrame:
    """The first split of the first class's tree in the first round."""
    fitted = models.xgb(n_rounds=1, max_depth=1).fit(_emb(spark, d))
    return spark.createDataFrame(_root(fitted.rounds[0][0]), "idx int, threshold double")


@query
def lr_first_step(spark: SparkSession, d: str) -> DataFrame:
    """Weights and bias (last) after one step from zero."""
    fitted = models.SoftmaxRegression(steps=1, init=0.0, rate=1.0).fit(_emb(spark, d))
    out = [(c, i, float(v)) for c, own in enumerate(zip(fitted.weights, fitted.bias)) for i, v in enumerate([*own[0], own[1]])]
    return spark.createDataFrame(out, "y int, idx int, w double").select("y", "idx", _r(F.col("w")).alias("weight"))


_TREE = trees.Tree({1: trees.Node(0, 0, 0.0), 2: trees.Node(0, 1, 0.05), 3: trees.Node(3), 4: trees.Node(1), 5: trees.Node(2)})


@query
def tree_predict(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("row_id", F.element_at(trees.predict_column([_TREE], F.col("x")), 1).cast("int").alias("p"))


@query
def boost_init(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preprocessed_data").where("y is not null")
    return models.log_priors(rows).select("y", _r(F.col("f0")).alias("f0"))


@query
def mnb_fit(spark: SparkSession, d: str) -> DataFrame:
    priors, logs = models.mnb_counts(_emb(spark, d))
    return logs.join(priors, "y").select("y", "idx", _r(F.col("logp")).alias("logp"), _r(F.log("prior")).alias("log_prior"))


@query
def mnb_predict(spark: SparkSession, d: str) -> DataFrame:
    train, rest = _split(spark, d)
    return models.NaiveBayes().fit(train).transform(rest).select("row_id", "p")


@query
def softmax_lr_step(spark: SparkSession, d: str) -> DataFrame:
    """Gradient at zero weights: classes by features and bias."""
    import numpy as np

    rows = _emb(spark, d).where("y between 0 and 9")
    gw, gb, _ = models.softmax_gradient(rows, np.zeros((10, 64)), np.zeros(10))
    out = [(c, i, float(v)) for c in range(10) for i, v in enumerate([*gw[c], gb[c]])]
    return spark.createDataFrame(out, "y int, idx int, g double").select("y", "idx", _r(F.col("g")).alias("gradient"))


@query
def ovo_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = sorted(r[0] for r in table(spark, d, "class_dim").where("selected").select("name").collect())
    return spark.createDataFrame([(names[i], names[j]) for i, j in models.class_pairs(names)], "name string, other string")


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Three voters whose label is a dimension's place in a coarse grid."""
    vote = lambda i: F.struct(F.lit(f"m{i}").alias("model"), (F.floor(F.col("x")[i] * 20) % 3 + 3).cast("int").alias("p"))
    return _emb(spark, d).select("row_id", F.explode(F.array(vote(0), vote(1), vote(2))).alias("v")).select("row_id", "v.*")


@query
def hard_vote(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.hard_vote(_votes(spark, d))


def _pair_model() -> models.SvmModel:
    import numpy as np

    w = np.zeros((3, 64))
    w[0, 0], w[1, 1], w[2, 2] = 1.0, 1.0, 1.0
    return models.SvmModel([0, 1, 2], [(0, 1), (0, 2), (1, 2)], w, np.array([0.0, 0.01, -0.01]))


@query
def ovo_vote(spark: SparkSession, d: str) -> DataFrame:
    return _pair_model().transform(_emb(spark, d)).select("row_id", "p")


@query
def feature_subset(spark: SparkSession, d: str) -> DataFrame:
    """The features that each of five trees may use, of the embeddings' dimensions."""
    size = _emb(spark, d).select(F.size("x").alias("n")).first()
    draw = models.RandomForest()
    rows = [(t, j) for t in range(5) for j in (draw.subset(t, size["n"]) if size else [])]
    return spark.createDataFrame(rows, "tree int, idx int")


# ---- ensembles and metrics ------------------------------------------------------


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Model, split, truth and a prediction that is wrong on every fifth row, or always the same."""
    rows = table(spark, d, "train").where("label_id is not null").select("row_id", F.col("label_id").alias("y"))
    a = F.when(F.col("row_id") % 5 == 0, (F.col("y") + 1) % 10).otherwise(F.col("y"))
    split = F.when(F.col("row_id") % 10 < 7, "train").when(F.col("row_id") % 10 < 9, "val").otherwise("test")
    both = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("A").alias("model"), a.cast("int").alias("p")), F.struct(F.lit(1).alias("ordinal"), F.lit("B").alias("model"), F.lit(3).alias("p")))
    return rows.select("row_id", "y", split.alias("split"), F.explode(both).alias("m")).select("row_id", "y", "split", "m.*")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_counts(_predictions(spark, d).where("model = 'A'"))


@query
def label_universe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_universe(_pairs(spark, d))


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(_pairs(spark, d))


@query
def per_class_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_class(_pairs(spark, d)).select("label", "tp", "fp", "fn", "support", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query
def prf_averages(spark: SparkSession, d: str) -> DataFrame:
    return metrics.averages(metrics.per_class(_pairs(spark, d))).select("average", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(metrics.pair_counts(_predictions(spark, d), ["model"]), ["model"]).select("model", _r(F.col("accuracy")).alias("accuracy"))


@query
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification_report(_pairs(spark, d)).select("ordinal", "label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "micro_f1")


@query
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.model_metrics(_predictions(spark, d).where("model = 'A'")).select(*[_r(F.col(c)).alias(c) for c in _METRICS])


@query
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = metrics.model_metrics(_predictions(spark, d).where("model = 'A'"), ["split"])
    return own.select("split", *[_r(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.model_metrics(_predictions(spark, d), ["ordinal", "model"]).select("ordinal", "model", *[_r(F.col(c)).alias(c) for c in _METRICS])


@query
def best_model(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_model(comparison_table(spark, d)).select("model", "macro_f1")


@query
def vote_weights(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.vote_weights(comparison_table(spark, d).select("model", F.col("macro_f1").alias("f1"))).select("model", _r(F.col("weight")).alias("weight"))


@query
def soft_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three models that take three slices of a vector, by softmax."""
    rows = _emb(spark, d)
    votes = None
    for i in range(3):
        own = rows.select("row_id", F.lit(f"m{i}").alias("model"), F.posexplode(V.softmax(F.slice("x", 3 * i + 1, 3))).alias("label", "q"))
        votes = own if votes is None else votes.unionByName(own)
    weights = spark.createDataFrame([("m0", 0.45), ("m1", 0.3), ("m2", 0.25)], "model string, weight double")
    return ensemble.soft_vote(votes, weights).select("row_id", "label", _r(F.col("q")).alias("q"))


@query
def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of the accuracy over five folds."""
    folds = corpus.kfold(_predictions(spark, d).where("model = 'A'"), 5)
    own = metrics.accuracy(metrics.pair_counts(folds, ["fold"]), ["fold"])
    return search.fold_summary(own, "accuracy").select(_r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


# ---- trained models, without SQL twins -------------------------------------------


def _predicted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Whole vectors and all labels, with the operator's own parameters."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        train, rest = _split(spark, d)
        return models.base_model(name).fit(train).transform(rest).select("row_id", "y", "p", F.transform("probability", lambda v: F.round(v, 6)).alias("probability"))

    return run


QUERIES |= {
    "decision_tree_predict": _predicted("decision_tree"),
    "forest_predict": _predicted("random_forest"),
    "gbdt_predict": _predicted("gbdt"),
    "xgb_predict": _predicted("xgboost"),
    "lgbm_predict": _predicted("lightgbm"),
    "svm_predict": _predicted("svm"),
    "lr_predict": _predicted("logistic_regression"),
}


@query
def oof_layout(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _split(spark, d)
    return ensemble.laid_out(ensemble.out_of_fold(train, {"naive_bayes": {}, "knn": {}}), ["naive_bayes", "knn"]).select("row_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query
def stacking(spark: SparkSession, d: str) -> DataFrame:
    train, rest = _split(spark, d)
    fitted = ensemble.fit_stacked(train, rest, {"naive_bayes": {}, "knn": {}})
    return fitted.transform(rest)


def _families(spark: SparkSession, d: str, part: str) -> dict[str, DataFrame]:
    """Three families of whole vectors, of one split by id: the embeddings, turned round and normalised."""
    rows = corpus.with_split(_emb(spark, d)).where(F.col("split") == part)
    own = {"tfidf": F.col("x"), "word2vec": F.reverse("x"), "bert": V.layer_norm(F.col("x"))}
    return {n: rows.select("row_id", x.alias("x")) for n, x in own.items()}


@query
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    labels = _emb(spark, d).select("row_id", "y")
    return search.grid_search(spark, _families(spark, d, "train"), _families(spark, d, "val"), labels)


@query
def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.cross_validate(_split(spark, d)[0])


@query
def encoder_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d)
    vocab = encoder.corpus_vocabulary(rows)
    c = encoder.EncoderConfig(vocab=200 + len(vocab), width=128, layers=2, heads=2, inner=512)
    return encoder.encoded(rows, encoder.random_weights(c), c, vocab)


@query
def w2v_vectors(spark: SparkSession, d: str) -> DataFrame:
    from wenloom.operators.wordvec import WordVectors

    own = _tokens(spark, d).where("split_name = 'train'")
    return WordVectors(size=16, epochs=1).fit(own).transform(own, None)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """From dirty headlines to the heaviest terms of each class."""
    rows = corpus.labeled(table(spark, d, "train"), table(spark, d, "class_dim"), selected=True)
    tokens = X.tokenize(X.clean_text(F.col("text")), X.IDEOGRAPHIC)
    docs = rows.where("text is not null").select("row_id", "name_cn", F.array_join(X.without_stopwords(tokens, STOPWORDS), " ").alias("text"))
    weights = terms.Tfidf().fit_transform(docs)[1]
    sums = weights.join(docs.select("row_id", "name_cn"), "row_id").groupBy("name_cn", "term").agg(F.sum("value").alias("weight"))
    first = F.row_number().over(Window.partitionBy("name_cn").orderBy(F.desc("weight"), "term"))
    return sums.withColumn("rank", first).where("rank <= 10")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
