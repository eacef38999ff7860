import base64
import itertools
import pathlib
import random
import subprocess
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wenloom.llm import bpe, copies, fmindex, forms, leaks, looks, overlap, quota, similar, subjects, terms

TEXT = "row_id long, text string, source string, canon string, root long"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", 1) for i, t in enumerate(rows)], TEXT)


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


# ---- looks, copies, forms (5, 7) ---------------------------------------------------


def test_looks():
    assert looks.skeleton("Ｆｅｎ​vі­k　⼈é") == "Fenvik 人é" and looks.skeleton("é") == "é" != "e"
    assert looks.skeleton("①²") == "①²" and looks.plain("Москва") == "Москва" and looks.plain("a\tb") == "a\tb"
    assert looks.parts("B ｜ a·A，│ ¦") == ["aa", "b"] == looks.parts("a A|b") and looks.parts(None) == looks.parts(" ") == []
    assert looks.has_word("⾥") and not looks.has_word("!| 　") and looks.skeleton(None) is None and looks.skeleton("") == ""


SAMPLES = ["甲|乙 丙", "丙乙｜甲", "丙乙｜甲", "乙丙 | 甲!", "AbC def", "abc DEF", "аbc def", None, "", " 　", "!!", "|", "x" * 50_000, "X" * 50_000 + "。", "甲乙丙"]


def brute_groups(rows, key, skip_equal):
    first, out = {}, set()
    for i, t in enumerate(rows):
        if looks.has_word(t):
            k = key(t)
            if k not in first:
                first[k] = (i, t)
            elif not (skip_equal and first[k][1] == t):
                out.add((first[k][0], i))
    return out


def test_copies(spark):
    records = copies.canonical(texts(spark, SAMPLES).repartition(3))
    groups = copies.collapse(records)
    got = {(r["first_row_id"], r["row_id"]) for r in copies.members(records, groups).collect()}
    assert got == brute_groups(SAMPLES, lambda t: tuple(looks.parts(t)), False)
    assert groups.agg(F.sum("copies")).first()[0] == sum(map(looks.has_word, SAMPLES))
    empty = copies.canonical(texts(spark, ["a"]).where("false"))
    assert copies.members(empty, copies.collapse(empty)).count() == 0


def test_forms(spark):
    rows = ["Fenvik 胜", "Fеnvik 胜", "Fenvi​k 胜", "Ｆenvik　胜", "fenvik 胜", "Fenvik  胜", "Quοq", "Quоq", "Москва", "Mосква", "сор", "cop", "cop", None, "", "①", "1", "é", "é"]
    formed = forms.forms(texts(spark, rows))
    by = {r["row_id"]: r["form"] for r in formed.collect()}
    assert len(by) == len(rows) and by[13] is None and by[14] == ""
    assert by[1] == by[2] == by[3] == "Fenvik 胜" and by[6] == by[7] == "Quoq" and by[8] == by[9] == "Москва" and by[10] == "cop"
    got = {(r["first_row_id"], r["row_id"]) for r in forms.lookalikes(formed).collect()}
    assert got == brute_groups(rows, looks.skeleton, True)
    assert forms.lookalikes(forms.forms(texts(spark, ["a"]).where("false"))).count() == 0


# ---- overlaps (1) ---------------------------------------------------------------------


def least(x, y):
    """The least edit distance over all orders of the parts."""
    p, q = looks.parts(x), looks.parts(y)
    return min(edit("|".join(i), "|".join(j)) for i in itertools.permutations(p) for j in itertools.permutations(q))


def brute_overlaps(train, evals):
    out = set()
    for i, x in enumerate(train):
        for j, y in enumerate(evals):
            if looks.has_word(x) and looks.has_word(y):
                n = max(len("|".join(looks.parts(t))) for t in (x, y))
                if least(x, y) <= n // 5:
                    out.add((i, j + 1000))
    return out


def found_overlaps(spark, train, evals):
    a, b = overlap.canonical(texts(spark, train)), overlap.canonical(texts(spark, evals).withColumn("row_id", F.col("row_id") + 1000))
    got = [(r["train_row_id"], r["eval_row_id"]) for r in overlap.overlaps(a, b).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("bars", [False, True])
def test_overlap_against_all_pairs(spark, bars):
    rng = random.Random(4)
    chars = "天地玄黄宇宙洪荒日月盈昃"
    base = ["".join(rng.choice(chars) for _ in range(rng.choice([3, 5, 6, 7, 10, 11, 14, 15, 19, 20, 25, 31]))) for _ in range(40)]
    if bars:
        base = ["|".join(t[i : i + rng.choice([1, 4, 9])] or "x" for i in rng.sample(range(0, len(t)), min(3, len(t)))) for t in base]

    def changed(t):
        t = t.split("|")
        rng.shuffle(t)
        t = list("|".join(t))
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = [rng.choice("天地x|" if bars else "天地x")] * rng.randint(0, 1)
        return "".join(t)

    train = base + [changed(t) for t in base] + [None, "", "!", base[0], base[0]]
    evals = [changed(rng.choice(base)) for _ in range(50)] + [base[0], None, " "]
    want = brute_overlaps(train, evals)
    assert found_overlaps(spark, train, evals) == want and len(want) > 40
    if not bars:
        a = overlap.canonical(texts(spark, train))
        assert overlap.overlaps(a.where("false"), a).count() == overlap.overlaps(a, a.where("false")).count() == 0


def test_overlap_with_edits_where_parts_begin(spark):
    rng = random.Random(9)
    word = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9))
    rows = [[word() for _ in range(1 + i % 4)] for i in range(60)]
    evals = ["｜".join(rng.sample([rng.choice(["一", "龥"]) + p[rng.randint(0, 1) :] for p in own], len(own))) for own in rows]
    train = ["|".join(own) for own in rows]
    assert found_overlaps(spark, train, evals) == {(i, i + 1000) for i in range(60)}
    many = [f"{i}部分" for i in range(12)]
    assert overlap.near("|".join(many), "|".join([*many[:0:-1], "另部分"])) and not overlap.near("|".join(many), "|".join(many[3:]))


def test_shared_passages_are_covered_whole(spark):
    t = "".join(chr(0x4E00 + 11 * i) for i in range(40))
    a, b = overlap.canonical(texts(spark, [t])), overlap.canonical(texts(spark, [t[:20] + "x" + t[21:]]))
    pairs = overlap.overlaps(a, b)
    assert [tuple(r) for r in pairs.collect()] == [(0, 0, 39)]
    assert overlap.report(pairs, b.select("row_id", F.lit("dev").alias("split_name"), F.lit("s").alias("source"))).first()["covered"] == 39
    assert overlap.covered_by("甲乙丙丁", "乙丙丁") == 3 and overlap.covered_by("ababx", "abab") == 4 and overlap.covered_by("甲", "乙") == 0


def test_suffix_order_and_common_prefixes():
    rng = random.Random(2)
    own = ["".join(rng.choice("ab|") for _ in range(rng.randint(1, 30))).strip("|") or "a" for _ in range(50)]
    s = overlap.Suffixes(own)
    at = np.flatnonzero(~s.stop[: len(s.text)])
    tail = lambda p: own[s.text[p]][p - s.start[s.text[p]] :][: overlap.DEPTH]
    order = at[np.lexsort((s.tail[at], s.head[at]))]
    assert [tail(p) for p in order] == sorted(tail(p) for p in at)
    shared = overlap.common_prefix(s.head[order], s.tail[order])
    for k in range(1, len(order)):
        x, y = tail(order[k - 1]).ljust(8, "\0"), tail(order[k]).ljust(8, "\0")
        assert shared[k] == next((i for i in range(8) if x[i] != y[i]), 8)


def test_hot_prefix_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PARTITION_SUFFIXES", 60)
    monkeypatch.setattr(overlap, "CHUNK", 50)
    train = [f"独家消息{chr(0x4E00 + 7 * i)}{chr(0x5E00 + 3 * i)}记者" for i in range(60)]
    assert found_overlaps(spark, train, [t.replace("记", "计") for t in train]) == {(i, i + 1000) for i in range(60)}


@pytest.mark.parametrize("t", ["独" * 60_000, "|".join(["甲乙"] * 20_000)])
def test_overlap_of_very_long_texts(spark, t):
    assert found_overlaps(spark, [t, "x" + t], [t[1:]]) == {(0, 1000), (1, 1000)}


def test_texts_far_apart_are_not_tried(monkeypatch):
    """No edits are counted for the orders of parts that hold other characters."""
    tried = []
    monkeypatch.setattr(overlap, "edits", lambda a, b, most, f=overlap.edits: tried.append(a) or f(a, b, most))
    assert not overlap.near("abcdef|ghijkl|mnopqr|stuvwx", "abcdef|GHIJKL|mnopqr|STUVWX") and not tried
    assert overlap.near("abcdef|ghijkl|mnopqr|stuvwx", "stuvwX|mnopqr|ghijkl|abcdef")


@pytest.mark.parametrize("bars", [0.0, 0.5])
def test_candidates_of_pieces(monkeypatch, bars):
    rng = np.random.default_rng(17)
    monkeypatch.setattr(overlap, "CHUNK", 500)

    def text(n):
        t = rng.choice(list("abcdefgh"), n)
        return "".join(np.where(rng.random(n) < 0.08, "|", t) if rng.random() < bars else t).strip("|").replace("||", "|")

    def altered(t):
        t = list(t)
        for _ in range(len(t) // 5):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = [[], [t[at], "z"], ["y"]][int(rng.integers(0, 3))]
        return "".join(t).strip("|").replace("||", "|")

    offers = sorted({text(int(n)) for n in rng.integers(14, 30, 200)})
    asks = sorted({altered(t) for t in offers * 2} | {text(int(n)) for n in rng.integers(14, 30, 200)})

    class Plan:
        asked, bounds = np.ones((overlap.LONG + 1, overlap.WIDTH + 1), bool), np.zeros(0, np.uint64)
        count = np.zeros(1 << 12, np.int64)

    np.add.at(Plan.count, overlap._slot(overlap.Suffixes(offers).offered(Plan.asked)[1], 1 << 12), 1)
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["text_id", "canon"])
    all_bits = np.full(overlap.BITS // 64, 2**64 - 1, np.uint64)
    entries = [x.to_pandas() for texts, known in ((asks, all_bits), (offers, None)) for x in overlap._placed(Plan, known)(iter([batch(texts)]))]
    got = overlap._array(pd.concat(entries, ignore_index=True).drop(columns="part"))
    met = set(zip(got["ask"], got["offer"]))
    near = {(i, j) for i, a in enumerate(asks) for j, b in enumerate(offers) if overlap.near(a, b)}
    assert near <= met and len(near) > 100
    if not bars:
        # Of texts without bars the pieces' places leave few others.
        assert len(met) < 8 * len(near)


# ---- quotas (3) ------------------------------------------------------------------------


def test_allocation():
    paths = {1: ("a",), 2: ("a",), 3: ("b",)}
    give = quota.allocate(paths, {1: 10, 2: 2, 3: 2}, {1: 4, 2: 5, 3: 50})
    assert give == {1: 4, 2: 5, 3: 5}  # siblings first, then cousins
    assert sum(quota.allocate(paths, {1: 5, 2: 5, 3: 5}, {1: 1, 2: 1, 3: 1}).values()) == 3
    assert quota.allocate({}, {}, {}) == {}


def test_samples(spark):
    rows = [(i, f"k{i % 90}", [0, 1, None][i % 3], "x") for i in range(180)] + [(500, None, 0, "x")]
    train = spark.createDataFrame(rows, "row_id long, headline_key string, label_id int, n string")
    plans = spark.createDataFrame([(1, 0, 0.5, 25, 0), (1, 1, 0.5, 100, 0), (1, 7, None, None, 3), (2, 0, 0.1, 25, None)], "plan_id int, label_id int, target_share double, sample_rows long, min_rows long")
    tree = spark.createDataFrame([(0, ["a"]), (1, ["a"])], "label_id int, path array<string>")
    distinct = quota.records(train)
    count = quota.counts(distinct)
    report = quota.plan_report(plans, count, tree)
    by = {(r["plan_id"], r["label_id"]): r for r in report.collect()}
    assert by[1, 0]["needed"] == 13 and by[2, 0]["needed"] == 3 and by[1, 1]["short"] == 20 and by[1, 7]["short"] == 3
    drawn = quota.draw(distinct, count, report)
    n = {(r["plan_id"], r["label_id"]): r["n"] for r in drawn.groupBy("plan_id", "label_id").agg(F.count_distinct("row_id").alias("n")).collect()}
    assert n == {k: r["drawn"] for k, r in by.items() if r["drawn"]} and drawn.count() == sum(n.values())
    assert quota.plan_report(plans.where("false"), count, tree).count() == 0


# ---- vectors (4) ------------------------------------------------------------------------


def test_similar(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 100))
    for i in range(0, 100, 2):
        x[i + 1] = x[i] + rng.normal(size=100) * [0.2, 0.45][i // 2 % 2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0] * 99), (903, [0.0] * 100), (904, [float("nan")] * 100), (905, [float("inf")] * 100), (906, (x[0] * 1e-3).tolist())]
    df = spark.createDataFrame(rows, "row_id long, v array<float>").withColumn("cosine", F.lit("clash"))
    vectors = similar.prepared(df, "f", "row_id", "v")
    assert vectors.count() == 601
    full = np.r_[x, x[:1] * 1e-3]
    ids = np.r_[np.arange(600), 906]
    u = full / np.linalg.norm(full, axis=1, keepdims=True)
    c = u @ u.T
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(c >= 0.9)) if ids[i] < ids[j]}
    for cell_rows in (10_000, 200):
        got = {(r["low_row_id"], r["high_row_id"]) for r in similar.alike(vectors, 0.9, cell_rows).collect()}
        assert got == want and len(want) > 20
    np.fill_diagonal(c, -2)
    near = similar.nearest(vectors, 10).collect()
    mine = {}
    for r in near:
        mine.setdefault(r["row_id"], set()).add(r["other_row_id"])
    assert np.mean([len(mine[ids[i]] & set(ids[np.argsort(-c[i])[:10]])) for i in range(len(ids))]) >= 9
    assert similar.alike(vectors.where("false"), 0.9).count() == 0
    assert similar.nearest(vectors.where("row_id < 3"), 10).count() == 6


@pytest.mark.parametrize("cells", [2, 8, 80])
def test_partners_in_few_directions_meet(cells):
    rng = np.random.default_rng(5)
    scale = 1 / np.arange(1, 101)
    x = similar._unit(rng.normal(size=(4_000, 100)) * scale)
    away = rng.normal(size=x.shape) * scale
    away -= (away * x).sum(axis=1, keepdims=True) * x
    cosine = rng.uniform(0.9, 0.95, (len(x), 1))
    y = similar._unit(cosine * x + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True))
    c = similar.centroids(np.concatenate([x, y]), cells)
    (home, visit), (other, back) = (similar._visits(v, c, 0.9, None) for v in (x, y))
    at = np.arange(len(x))
    assert np.all(visit[at, other] | back[at, home]) and np.any(home != other)


def test_similar_with_falling_spectrum(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 100)) / np.arange(1, 101)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = similar.prepared(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<float>"), "f", "row_id", "v")
    near = u @ u.T
    got = {(r["low_row_id"], r["high_row_id"]) for r in similar.alike(vectors, 0.9, 150).collect()}
    sure = {(i, j) for i, j in zip(*np.nonzero(near >= 0.9 + 1e-5)) if i < j}
    may = {(i, j) for i, j in zip(*np.nonzero(near >= 0.9 - 1e-5)) if i < j}
    assert sure and sure <= got <= may


def shapes(n=2_000):
    """Vectors without and with strong directions, in clusters, and most of them nearly equal."""
    rng = np.random.default_rng(11)
    noise = rng.normal(size=(n, 100))
    strong = np.r_[np.ones(2), np.full(98, 0.1)]
    centers = rng.normal(size=(20, 100)) * 2
    hot = noise * np.where(rng.random((n, 1)) < 0.9, 0.05, 1) + np.r_[3, np.zeros(99)]
    return {"isotropic": noise, "low rank": noise * strong, "clusters": centers[rng.integers(0, 20, n)] + noise, "hot cell": hot}


@pytest.mark.parametrize("shape", ["isotropic", "low rank", "clusters", "hot cell"])
def test_recall_of_similar_vectors(spark, monkeypatch, shape):
    for name, rows in (("PART_ROWS", 400), ("MEMBER_ROWS", 700), ("QUERY_ROWS", 300), ("PAIRS", 5_000)):
        monkeypatch.setattr(similar, name, rows)
    x = similar._unit(shapes()[shape])
    x[1::20] = similar._unit(x[::20] + np.random.default_rng(1).normal(size=(100, 100)) * 0.04)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<float>")
    vectors = similar.prepared(df, "f", "row_id", "v")
    c = x.astype(np.float64) @ x.T.astype(np.float64)
    sure, may = (np.triu(c >= 0.95 + e, 1) for e in (1e-5, -1e-5))
    for exact in (True, False):
        got = np.zeros(c.shape, bool)
        found = similar.alike(vectors, 0.95, 300, exact).toPandas()
        got[found["low_row_id"], found["high_row_id"]] = True
        assert len(found) == got.sum() and not (got & ~may).any() and sure.any()
        assert not (sure & ~got).any() if exact else (sure & got).sum() >= 0.999 * sure.sum()
    np.fill_diagonal(c, -2)
    tenth = -np.sort(-c, axis=1)[:, 9]
    for exact, least in ((True, 1.0), (False, 0.99)):
        near = similar.nearest(vectors, 10, None, 300, exact).toPandas()
        assert len(near) == 10 * len(x)
        assert np.mean(c[near["row_id"], near["other_row_id"]] >= tenth[near["row_id"]] - 1e-5) >= least


def test_vectors_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART_ROWS", 60)
    x = similar._unit(np.random.default_rng(8).normal(size=(1_200, 100)))
    x[1::20] = similar._unit(x[::20] + np.random.default_rng(9).normal(size=(60, 100)) * 0.03)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1_200, x[0].tolist()), (1_200, x[1].tolist())]
    vectors = similar.prepared(spark.createDataFrame(rows, "row_id long, v array<float>"), "f", "row_id", "v")
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        """Shuffled bytes by stage."""
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = written()
    found = similar.alike(vectors, 0.9, 200).toPandas()
    # Every vector meets every cell here, yet its 408 bytes are moved once, and once for the sample, which holds all of them.
    assert 0 < sum(v for k, v in written().items() if k not in before) < 3 * 408 * len(rows)
    full, ids = np.r_[x, x[:2]].astype(np.float64), np.r_[np.arange(1_200), 1_200, 1_200]
    a, b = np.triu_indices(len(ids), 1)
    cosine = (full @ full.T)[a, b] / np.linalg.norm(full, axis=1)[a] / np.linalg.norm(full, axis=1)[b]
    want = sorted((int(i), int(j)) for i, j, c in zip(ids[a], ids[b], cosine) if c >= 0.9 and i != j)
    assert sorted(zip(found["low_row_id"], found["high_row_id"])) == want and len(want) > 60


def test_bits_that_may_differ():
    rng = np.random.default_rng(3)
    x = similar._unit(rng.normal(size=(20_000, 100)))
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = similar._unit(0.9 * x + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1, keepdims=True))
    off = np.bitwise_count(similar.encode(x)[0] ^ similar.encode(y)[0]).sum(axis=1)
    assert off.max() <= similar.most_bits(0.9) < 64 and similar.most_bits(1.0) == 0 and similar.most_bits(-1.0) == 128
    guess = similar.Estimate(x[:500])
    wrong = np.abs(guess.of(y[:500]) - y[:500] @ x[:500].T)
    assert np.mean(wrong <= guess.off) > 0.9


# ---- terms (6) ---------------------------------------------------------------------------


@pytest.mark.parametrize("batch", [1_000_000, 300])
def test_terms(spark, monkeypatch, batch):
    monkeypatch.setattr(terms, "BATCH_TOKENS", batch)
    monkeypatch.setattr(terms, "ROW_PAIRS", 7)
    rng = random.Random(2)
    rows = [(i, [rng.choice(["a", "b", "c", "A", "", " ", None, "x" * 5000]) for _ in range(rng.randint(0, 9))] + ["hot"]) for i in range(400)]
    rows += [(500, None), (501, []), (502, ["once"]), (0, ["hot", "again"])]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>").withColumn("term", F.lit("clash")).repartition(5)
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.marked(terms.frequencies(df), df).collect()}
    want = {}
    for i, own in rows:
        for t in own or []:
            if t and t.strip():
                n, r = want.setdefault(t, [0, set()])
                want[t] = [n + 1, r | {i}]
    total = len({i for i, t in rows if t is not None})
    assert got == {t: (n, len(r), "rare" if len(r) < 2 else "common" if len(r) > 0.8 * total else None) for t, (n, r) in want.items()}
    assert terms.frequencies(df.where("false")).count() == 0


# ---- encoding (8) ------------------------------------------------------------------------


def test_encoding(spark):
    import tiktoken

    path = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = ["", None, "aaaaaaa aaaa", "  \n\n x", "<|endoftext|>", "中文，测试 test's 123", "é😀" * 50, "ab" * 20_000] + ["".join(rng.choice("abc \n中1'é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(spark.createDataFrame([(None, "a")], "doc_id long, text string"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df).collect()}
    assert got.pop(None) == plain.encode_ordinary("a")
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(rows)}
    assert bpe.encoded(df.where("false")).count() == 0


# ---- leaks (9) ----------------------------------------------------------------------------


def test_full_text_index():
    rng = random.Random(0)
    own = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["abcab"] * 4 + ["a" * 300]
    index = fmindex.Index(own)
    joined = "\0".join([*own, ""])
    for phrase in ("a", "abc", "cab", "aaaa", "z"):
        _, at = index.search(np.array([[ord(c) for c in phrase]], np.uint32))
        assert sorted(at) == [i for i in range(len(joined)) if joined.startswith(phrase, i)]
    order = fmindex.suffix_array(np.array([3, 1, 2, 1, 2, 1, 0]) + 1)
    assert order.tolist() == sorted(range(7), key=lambda i: [3, 1, 2, 1, 2, 1, 0][i:])


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    lead = "阅读下面的材料。"
    wording = [word(120) for _ in range(6)]
    items = [(i, lead + w) for i, w in enumerate(wording)] + [(10, None), (11, ""), (12, lead), (13, wording[0])]
    part = wording[0][:70]
    noisy = part[:20] + "改" + part[21:40] + "增" + part[40:55] + part[56:]
    docs = [word(200) + part + word(100), word(50) + "，".join(noisy), lead + word(300), word(30) + wording[1][:50] + word(40), None, "", wording[2], word(10) + wording[3][:30] + word(5) + wording[3][30:60], wording[4][::-1], word(200_000) + wording[5]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leaks.leaked(leaks.passages(d, t)).collect()}
    assert got == {(0, 0), (13, 0), (0, 1), (13, 1), (2, 6), (5, 9)}
    assert leaks.passages(d.where("false"), t).count() == leaks.passages(d, t.where("false")).count() == 0


# The peak is read from the process itself: getrusage would count what the parent held before the call.
REPETITIVE = """
import re
import numpy as np
from wenloom.llm import leaks
unit = "春风又绿江南岸明月何时照我还此处有一句重复的话"
own = leaks.Items([(0, unit * 3 + "".join(chr(0x5000 + i) for i in range(80))), (1, unit * 4)])
doc = unit[:20] * 50_000 + (unit * 3)[5:] + "".join(chr(0x5000 + i) for i in range(40)) + unit * 400
found = leaks.search(own, leaks.Index([doc]), [np.frombuffer(doc.encode("utf-32-le"), np.uint32)])
print(len(doc), sorted({f[0] for f in found}), int(re.search("VmHWM:\\\\s*(\\\\d+)", open("/proc/self/status").read())[1]) // 1000)
"""


def test_repetitive_documents_need_little_memory():
    out = subprocess.run([sys.executable, "-c", REPETITIVE], capture_output=True, text=True, cwd=pathlib.Path(__file__).parents[2], check=True).stdout
    size, rest = out.split(" ", 1)
    found, peak = rest.rsplit(" ", 1)
    assert int(size) > 1_000_000 and found == "[0, 1]" and int(peak) < 1_000


def test_long_items_with_shifts():
    rng = random.Random(3)
    item = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2_000))
    part = item[300:1500]
    noisy = part[:200] + "增" + part[200:500] + part[501:900] + "改" + part[901:]
    doc = "前" * 50 + noisy + "后" * 50
    own = leaks.Items([(0, item)])
    found = leaks.search(own, leaks.Index([doc, ""]), [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (doc, "")])
    assert len(found) == 1 and found[0][:2] == (0, 0) and abs(found[0][2] - 300) <= 70 and found[0][3] <= 55 and found[0][4] >= 1_150
    assert leaks.merged([(0, 10, 5), (3, 14, 6), (0, 40, 5)]) == [(0, 10, 10), (0, 40, 5)]


def test_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 200)
    monkeypatch.setattr(leaks, "SHARD_CHARS", 300)
    rng = random.Random(1)
    word = [("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))) for _ in range(12)]
    d = spark.createDataFrame([(i, "前言" + w + "后记") for i, w in enumerate(word)], "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in leaks.leaked(leaks.passages(d, d.selectExpr("doc_id as item_id", "substring(text, 3, 60) as text"))).collect()}
    assert got == {(i, i) for i in range(12)}


@pytest.mark.parametrize("n", [3, 10, 19, 20, 21, 40, 61, 120, 400])
def test_phrases_cannot_be_missed(n):
    length, stride, need = leaks.plan(n)
    rng = random.Random(n)
    for _ in range(300):
        m = rng.randint(-(-n // 2), n)
        start, bad = rng.randint(0, n - m), set()
        while len(bad) < m // leaks.RARE:
            bad.add(start + rng.randrange(m))
        whole = [a for a in range(0, n - length + 1, stride) if a >= start and a + length <= start + m and not any(a <= b < a + length for b in bad)]
        assert len(whole) >= need


# ---- subjects (10) ---------------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(8)
    nouns = {k: ["".join(chr(0x4E00 + 400 * k + 20 * j + i) for i in range(2)) for j in range(12)] for k in range(3)}
    filler = ["此事仍有后续消息", "天气转凉行人渐少"]
    say = lambda k: "今天" + "".join(rng.sample(nouns[k], 3))
    headlines = spark.createDataFrame([(say(i % 3), [i % 3, None, 99][0 if i % 20 else i // 20 % 3]) for i in range(600)], "text string, label_id int")
    want, docs = set(), []
    for i in range(200):
        k, j = rng.randrange(3), rng.randrange(3)
        own = [say(k) for _ in range(4)] + [say(j)] * (i % 2 * 2) + [rng.choice(filler)] * 3
        rng.shuffle(own)
        docs.append((i, "。".join(own) + "。"))
        want |= {(i, k)} | ({(i, j)} if i % 2 else set())
    docs += [(1000, None), (1001, ""), (1002, "。".join(filler)), (1003, " \n")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(5)] + [(7, None), (8, 77)], "doc_id long, label_id int")
    model = subjects.model(headlines, d, labels)
    got = {(r["doc_id"], r["label_id"]) for r in subjects.subjects(subjects.on_classes(*model)).collect()}
    assert len(got ^ want) <= 0.03 * len(want)
    none = subjects.model(headlines.where("false"), d, labels.where("false"))
    assert subjects.on_classes(*none).count() == 0


def test_no_telling_term_is_left_out(spark):
    pairs = [chr(0x4E00 + i) + chr(0x6E00 + i % 97) for i in range(9_000)]
    texts = [" ".join(pairs[k::10][i : i + 20]) for k in range(10) for i in range(0, 900, 20)]
    often = [(t, i // 45, 5 if i % 45 else 4) for i, t in enumerate(texts)]
    headlines = spark.createDataFrame([(t, k) for t, k, n in often for _ in range(n)], "text string, label_id int")
    docs = spark.createDataFrame([(k * 45 + i, "。".join(pairs[k::10][i * 20 + j] + "，" + pairs[k::10][i * 20 + j + 1] for j in (0, 6, 12))) for k in range(10) for i in range(45)], "doc_id long, text string")
    model = subjects.model(headlines, docs, spark.createDataFrame([], "doc_id long, label_id int"))
    assert len(model[1].names) == 9_000
    got = {r["doc_id"]: r["at"] for r in subjects.encoded(docs, model[1]).groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at")).collect()}
    assert len(got) == 450 and all(len(a) == 6 for a in got.values())
    x = model[2].writable()
    gram = x.T @ x
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-3)


def test_names_are_normal():
    assert all(unicodedata.is_normalized("NFC", k) for k in looks.LOOKS_LIKE)
