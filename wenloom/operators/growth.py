"""Decision trees on binned values: histograms per node, summed over the partitions.

Values become codes: a feature with at most ``bins`` distinct values keeps them
all, so that its thresholds are exact; others get that many quantile edges. A
node's histogram holds the sums of its rows' statistics per feature and code; the
best threshold comes from their running sums.

Up to LOCAL_CELLS values (rows times features) a fit is one task, a forest one
task a tree. Beyond, a level is one job: each task sends the histograms of its
rows, which are added in two steps (partitions in groups first, features in
blocks), and a row per node reaches the driver. Both take the same histograms and
splits; they differ in the order of additions only. ``trees.grow`` is the exact
way for any number of distinct values.

A split sends ``x[feature] <= threshold`` left; NaN and null go right. Ties of
gain (12 digits) go to the smaller feature, then the smaller threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wenloom.operators.trees import Criterion, Node, Tree
from wenloom.sources.tables import cut

BINS = 1_024
LOCAL_CELLS = 20_000_000
#: Codes of all features together; more features have fewer bins, at least 32.
MOST_CODES = 4_000_000
#: A node's rows are sorted once they hold at most so many values a cell.
SORTED_SHARE = 2
BLOCK = 16
GROUPS = 64
KEEP = 10


def bins_for(size: int, bins: int) -> int:
    return max(32, min(bins, MOST_CODES // max(1, size)))


def matrix(x: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in x], np.float64)


def local_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for v in x.T:
        own = np.unique(v[~np.isnan(v)])
        if len(own) > bins:
            own = np.unique(np.quantile(v[~np.isnan(v)], np.arange(1, bins + 1) / bins, method="inverted_cdf"))
        out.append(own)
    return out


def edges(rows: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """By a mergeable quantile sketch per feature."""
    flat = rows.select(F.posexplode("x").alias("idx", "value")).where("not isnan(value)")
    levels = F.percentile_approx("value", F.array(*[F.lit((i + 1) / bins) for i in range(bins)]), 10_000)
    got = {r["idx"]: np.unique(r["e"]) for r in flat.groupBy("idx").agg(levels.alias("e")).collect()}
    return [got.get(i, np.zeros(0)) for i in range(size)]


def coded(x: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """The first edge that isn't smaller; one beyond the last for larger values and NaN."""
    return np.stack([np.searchsorted(e, v, "left") for e, v in zip(own, x.T)], axis=1).astype(np.uint16)


class Shape:
    """Where each feature's codes lie in one row of cells."""

    def __init__(self, own: list[np.ndarray]):
        self.size = np.array([len(e) + 1 for e in own], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.cells = int(self.size.sum())
        self.feature = np.repeat(np.arange(len(own)), self.size)


def histogram(codes: np.ndarray, stats: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Cells that hold rows, in order, and the sums of the statistics in them."""
    at = (codes + shape.start).ravel()
    f = codes.shape[1]
    if at.size * 4 >= shape.cells:
        count = np.bincount(at, minlength=shape.cells)
        cells = np.flatnonzero(count)
        return cells, np.stack([np.bincount(at, np.repeat(s, f), shape.cells)[cells] for s in stats.T], axis=1)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[first], np.add.reduceat(stats[order // f], first, axis=0) if len(at) else np.zeros((0, stats.shape[1]))


def best_split(cells: np.ndarray, sums: np.ndarray, total: np.ndarray, shape: Shape, criterion: Criterion, least: int, allowed: np.ndarray | None = None) -> tuple[float, int, int]:
    """Gain, feature and code of the first best threshold; gain 0 if none is any good."""
    if not len(cells):
        return 0.0, -1, 0
    feature = shape.feature[cells]
    run = np.cumsum(sums, axis=0)
    first = np.r_[True, feature[1:] != feature[:-1]]
    before = np.maximum.accumulate(np.where(first, np.arange(len(cells)), 0))
    left = run - np.where(before[:, None] > 0, run[before - 1], 0)
    code = cells - shape.start[feature]
    gain = criterion.gains(total, left, least)
    gain[code >= shape.size[feature] - 1] = -np.inf
    if allowed is not None:
        gain[~np.isin(feature, allowed)] = -np.inf
    gain = np.round(gain, 12)
    k = int(np.argmax(gain))
    return (float(gain[k]), int(feature[k]), int(code[k])) if gain[k] > 0 else (0.0, -1, 0)


def _stops(depth: int, total: np.ndarray, criterion: Criterion, max_depth: int | None, min_split: int) -> bool:
    return (max_depth is not None and depth >= max_depth) or criterion.rows(total) < min_split or criterion.single(total)


def presorted(codes: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows in the order of each feature's codes, and those codes; None where the histograms have fewer cells than that."""
    if codes.size > SORTED_SHARE * shape.cells:
        return None
    order = np.ascontiguousarray(np.argsort(codes, axis=0, kind="stable").T)
    return order, np.take_along_axis(codes.T, order, axis=1)


def sorted_split(order: np.ndarray, code: np.ndarray, stats: list[np.ndarray | None], total: np.ndarray, criterion: Criterion, least: int) -> tuple[float, int, int]:
    """As ``best_split``, from sorted rows (features by rows) and each statistic of all rows, None if it is one everywhere."""
    n = order.shape[1]
    left = [np.arange(1.0, n + 1) if own is None else np.cumsum(v := own.take(order), axis=1, out=v) for own in stats]
    gain = criterion.gains_of(total, left, least)
    gain[:, -1:] = -np.inf
    np.copyto(gain[:, :-1], -np.inf, where=code[:, :-1] == code[:, 1:])
    gain = gain.ravel()
    k = int(np.argmax(gain)) if n else 0
    if not n or not np.round(gain[k], 12) > 0:
        return 0.0, -1, 0
    # Only those within the rounding of the largest may share its rounded gain.
    near = np.flatnonzero(gain >= gain[k] - 2e-12)
    k = int(near[np.argmax(np.round(gain[near], 12))])
    return float(np.round(gain[k], 12)), k // n, int(code.flat[k])


def grow_here(codes: np.ndarray, stats: np.ndarray, own: list[np.ndarray], shape: Shape, criterion: Criterion, max_depth: int | None, min_split: int, min_leaf: int, allowed: np.ndarray | None = None, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Tree, np.ndarray]:
    """One tree of the rows at hand, and each row's leaf value.

    Large nodes take histograms; smaller ones sort their rows by each feature once
    (``ordered``: all rows, sorted beforehand) and hand the order down.
    """
    tree, values = Tree(), np.zeros(len(codes))
    across = [None if i == 0 and criterion.counts_rows and (own == 1).all() else np.ascontiguousarray(own) for i, own in enumerate(stats.T)]
    goes = np.zeros(len(codes), bool)
    columns = np.arange(codes.shape[1]) if allowed is None else np.unique(allowed)
    if ordered is not None and allowed is not None:
        ordered = ordered[0][columns], ordered[1][columns]
    open_ = [(1, 0, np.arange(len(codes)), stats.sum(axis=0), ordered)]
    while open_:
        at, depth, rows, total, ordered = open_.pop()
        node = tree.nodes[at] = Node(criterion.leaf(total))
        if not _stops(depth, total, criterion, max_depth, min_split):
            if ordered is None and (found := presorted(codes[np.ix_(rows, columns)], shape)) is not None:
                ordered = rows[found[0]], found[1]
            if ordered is None:
                gain, feature, code = best_split(*histogram(codes[rows], stats[rows], shape), total, shape, criterion, min_leaf, allowed)
            else:
                gain, feature, code = sorted_split(*ordered, across, total, criterion, min_leaf)
                feature = int(columns[feature])
            if gain > 0:
                node.feature, node.threshold = feature, float(own[feature][code])
                left = codes[rows, feature] <= code
                if ordered is not None:
                    goes[rows] = left
                    to = goes.take(ordered[0])
                for i, part in enumerate((rows[left], rows[~left])):
                    sums, down = stats[part].sum(axis=0), None
                    if ordered is not None and not _stops(depth + 1, sums, criterion, max_depth, min_split):
                        places = np.flatnonzero(~to if i else to)
                        down = tuple(x.take(places).reshape(len(columns), -1) for x in ordered)
                    open_.append((2 * at + i, depth + 1, part, sums, down))
                continue
        values[rows] = node.value
    return tree, values


# ---- over partitions -----------------------------------------------------------------------


def _reached(tree: Tree, codes: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The deepest known nodes and the rows that reach them; numbers of deep nodes are larger than any integer type."""
    open_ = [(1, np.arange(len(codes)))]
    while open_:
        node, rows = open_.pop()
        n = tree.nodes.get(node)
        if n is None or n.feature < 0:
            if len(rows):
                yield node, rows
            continue
        left = codes[rows, n.feature] <= np.searchsorted(own[n.feature], n.threshold)
        open_ += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]


def leaf_values(tree: Tree, codes: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(codes))
    for node, rows in _reached(tree, codes, own):
        out[rows] = tree.nodes[node].value
    return out


_CELLS = "tree int, node string, block int, grp int, cells binary, sums binary, total binary"


def _added(criterion: Criterion):
    """Histograms of one node and block of features, added."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        width = criterion.width
        cells = np.concatenate([np.frombuffer(c, np.int64) for c in b["cells"]])
        sums = np.concatenate([np.frombuffer(s, np.float64).reshape(-1, width) for s in b["sums"]])
        order = np.argsort(cells, kind="stable")
        cells, sums = cells[order], sums[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        sums = np.add.reduceat(sums, first, axis=0) if len(cells) else sums
        total = sum(np.frombuffer(t, np.float64) for t in b["total"])
        head = b.iloc[0]
        return pd.DataFrame([(head["tree"], head["node"], head["block"], 0, cells[first].tobytes(), sums.tobytes(), total.tobytes())], columns=[c.split()[0] for c in _CELLS.split(", ")])

    return run


def grow_wide(rows: DataFrame, prepare: Callable[[pd.DataFrame], dict[int, tuple[np.ndarray, np.ndarray]]], trees: list[int], own: list[np.ndarray], criterion: Criterion, max_depth: int | None, min_split: int, min_leaf: int, allowed: dict[int, list[int]] | None = None) -> dict[int, Tree]:
    """Trees over all partitions. ``prepare`` gives the codes and statistics of a batch's rows for each tree."""
    shape = Shape(own)
    blocks = -(-len(own) // BLOCK)
    edge = shape.start[::BLOCK]
    grown = {t: Tree() for t in trees}
    open_ = {(t, 1) for t in trees}
    depth = 0
    while open_:

        def run(batches: Iterator[pd.DataFrame], grown: dict[int, Tree] = grown, wanted: set = open_) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], list] = {}
            for b in batches:
                if not len(b):
                    continue
                for t, (codes, stats) in prepare(b).items():
                    for n, at in _reached(grown[t], codes, own):
                        if (t, n) in wanted:
                            held.setdefault((t, n), []).append((codes[at], stats[at]))
            grp = TaskContext.get().partitionId() % GROUPS
            for (t, n), parts in held.items():
                codes, stats = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                cells, sums = histogram(codes, stats, shape)
                ends = np.append(np.searchsorted(cells, edge), len(cells))
                total = stats.sum(axis=0).tobytes()
                yield pd.DataFrame([(t, str(n), k, grp, cells[ends[k] : ends[k + 1]].tobytes(), sums[ends[k] : ends[k + 1]].tobytes(), total) for k in range(blocks)], columns=[c.split()[0] for c in _CELLS.split(", ")])

        def decide(b: pd.DataFrame) -> pd.DataFrame:
            head = b.iloc[0]
            one = _added(criterion)(b).iloc[0]
            total = np.frombuffer(one["total"], np.float64)
            may = None if allowed is None else np.array(allowed[int(head["tree"])])
            gain, feature, code = best_split(np.frombuffer(one["cells"], np.int64), np.frombuffer(one["sums"], np.float64).reshape(-1, criterion.width), total, shape, criterion, min_leaf, may)
            return pd.DataFrame([(head["tree"], head["node"], gain, feature, code, total.tobytes())], columns=["tree", "node", "gain", "feature", "code", "total"])

        cells = rows.mapInPandas(run, _CELLS).groupBy("tree", "node", "block", "grp").applyInPandas(_added(criterion), _CELLS)
        found = cells.groupBy("tree", "node", "block").applyInPandas(decide, "tree int, node string, gain double, feature int, code int, total binary").collect()
        best: dict[tuple[int, int], tuple] = {}
        for r in found:
            key = (r["tree"], int(r["node"]))
            new = (-r["gain"], r["feature"], r["code"], r["total"])
            if key not in best or (r["gain"] > 0 and new < best[key]):
                best[key] = new
        if not best and depth == 0:
            raise ValueError("no rows to grow a tree on")
        open_ = set()
        for (t, n), (gain, feature, code, total) in best.items():
            sums = np.frombuffer(total, np.float64)
            node = grown[t].nodes[n] = Node(criterion.leaf(sums))
            if gain < 0 and not _stops(depth, sums, criterion, max_depth, min_split):
                node.feature, node.threshold = feature, float(own[feature][code])
                open_ |= {(t, 2 * n), (t, 2 * n + 1)}
        depth += 1
    return grown


def table(trees: dict[int, Tree]) -> pd.DataFrame:
    return pd.DataFrame([(t, str(n[0]), *n[1:]) for t, tree in trees.items() for n in tree.table()], columns=["tree", "node", "feature", "threshold", "leaf", "value"])


TABLE = "tree int, node string, feature int, threshold double, leaf boolean, value double"


def from_table(rows: list) -> dict[int, Tree]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["leaf"], r["value"]))
    return {t: Tree.of(n) for t, n in sorted(out.items())}


def coded_rows(rows: DataFrame, own: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``codes`` (two bytes a feature) in place of ``x``, written once."""
    rest = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[[f.name for f in rest]].assign(codes=[c.tobytes() for c in coded(matrix(b["x"]), own)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", codes binary"
    return cut(rows.mapInPandas(run, schema))


def codes_of(b: pd.DataFrame, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["codes"]), np.uint16).reshape(len(b), size)


def fit(rows: DataFrame, criterion: Criterion, bins: int = BINS, max_depth: int | None = None, min_split: int = 2, min_leaf: int = 1, features: dict[int, list[int]] | None = None) -> dict[int, Tree]:
    """Trees by number from ``tree, x, w`` and the criterion's targets."""
    rows = rows.where("x is not null")
    head = rows.select(F.size("x")).first()
    if head is None:
        raise ValueError("no rows to grow a tree on")
    size = head[0]
    most = bins_for(size, bins)
    about = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()
    if max(r["n"] for r in about) * size <= LOCAL_CELLS:

        def grown(b: pd.DataFrame) -> pd.DataFrame:
            x, t = matrix(b["x"]), int(b["tree"].iloc[0])
            own = local_edges(x, most)
            may = None if features is None else np.array(features[t])
            tree, _ = grow_here(coded(x, own), criterion.stats(b), own, Shape(own), criterion, max_depth, min_split, min_leaf, may)
            return table({t: tree})

        return from_table(rows.groupBy("tree").applyInPandas(grown, TABLE).collect())
    own = edges(rows, size, most)

    def prepare(b: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        codes, stats, tree = codes_of(b, size), criterion.stats(b), b["tree"].to_numpy()
        return {int(t): (codes[tree == t], stats[tree == t]) for t in np.unique(tree)}

    return grow_wide(coded_rows(rows, own), prepare, sorted(r["tree"] for r in about), own, criterion, max_depth, min_split, min_leaf, features)


# ---- boosting ------------------------------------------------------------------------------


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _class_stats(criterion: Criterion, q: np.ndarray, y: np.ndarray, c: int) -> np.ndarray:
    hit = (y == c).astype(np.float64)
    one = np.ones(len(y))
    return np.stack([one, q[:, c] - hit, q[:, c] * (1 - q[:, c])], axis=1) if criterion.width == 3 else np.stack([one, hit - q[:, c]], axis=1)


def boost(rows: DataFrame, start: list[float], rate: float, rounds: int, criterion: Criterion, max_depth: int | None, min_split: int, min_leaf: int, bins: int = BINS, drawn: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[list[list[Tree]], list[float]]:
    """Rounds of one tree a class on the rows ``row_id, x, y``, and the mean loss after each.

    ``drawn(rows, round)`` gives ``row_id, grp``: the rows each class's tree sees.
    """
    k = len(start)
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    most = bins_for(size, bins)
    if drawn is None and n * size <= LOCAL_CELLS:

        def here(b: pd.DataFrame) -> pd.DataFrame:
            # In the order of the ids, so that sums don't depend on the partitions.
            b = b.sort_values("row_id", kind="stable")
            x, y = matrix(b["x"]), b["y"].to_numpy()
            own = local_edges(x, most)
            codes, shape = coded(x, own), Shape(own)
            ordered = presorted(codes, shape)
            f = np.tile(np.array(start), (len(y), 1))
            out = []
            for r in range(rounds):
                q = softmax(f)
                for c in range(k):
                    tree, values = grow_here(codes, _class_stats(criterion, q, y, c), own, shape, criterion, max_depth, min_split, min_leaf, ordered=ordered)
                    f[:, c] += rate * values
                    out.append(table({r * k + c: tree}))
                out.append(pd.DataFrame([(-1, str(r), -1, 0.0, True, float(-np.log(softmax(f)[np.arange(len(y)), y] + 1e-10).mean()))], columns=out[0].columns))
            return pd.concat(out)

        got = rows.select(F.lit(0).alias("g"), "row_id", "x", "y").groupBy("g").applyInPandas(here, TABLE).collect()
        trees = list(from_table([r for r in got if r["tree"] >= 0]).values())
        losses = [r["value"] for r in sorted((r for r in got if r["tree"] < 0), key=lambda r: int(r["node"]))]
        return [trees[i : i + k] for i in range(0, len(trees), k)], losses
    own = edges(rows, size, most)
    state = coded_rows(rows.select("row_id", "x", "y").withColumn("f", F.array(*[F.lit(float(s)) for s in start])), own)
    made: list[list[Tree]] = []
    losses: list[float] = []
    since = 0  # rounds that the written state knows

    def scores(b: pd.DataFrame, codes: np.ndarray, later: list[list[Tree]]) -> np.ndarray:
        f = matrix(b["f"])
        for own_round in later:
            f = f + rate * np.stack([leaf_values(t, codes, own) for t in own_round], axis=1)
        return f

    for r in range(rounds):
        later = made[since:]
        seen = state if drawn is None else state.join(drawn(state, r).groupBy("row_id").agg(F.collect_set("grp").alias("grps")), "row_id")

        def prepare(b: pd.DataFrame, later: list = later) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            codes, y = codes_of(b, size), b["y"].to_numpy()
            q = softmax(scores(b, codes, later))
            out = {}
            for c in range(k):
                at = np.full(len(y), True) if drawn is None else np.array([c in g for g in b["grps"]], bool)
                if at.any():
                    out[c] = codes[at], _class_stats(criterion, q[at], y[at], c)
            return out

        grown = grow_wide(seen, prepare, list(range(k)), own, criterion, max_depth, min_split, min_leaf)
        made.append([grown[c] for c in range(k)])

        def lost(batches: Iterator[pd.DataFrame], later: list = made[since:]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    q = softmax(scores(b, codes_of(b, size), later))
                    yield pd.DataFrame({"loss": [-np.log(q[np.arange(len(b)), b["y"].to_numpy()] + 1e-10).sum()], "n": [len(b)]})

        total = state.mapInPandas(lost, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
        losses.append(total[0] / total[1])
        if (r + 1) % KEEP == 0 and r + 1 < rounds:

            def moved(batches: Iterator[pd.DataFrame], later: list = made[since:]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    if len(b):
                        yield b.assign(f=list(scores(b, codes_of(b, size), later)))

            state, since = cut(state.mapInPandas(moved, state.schema)), len(made)
    return made, losses
