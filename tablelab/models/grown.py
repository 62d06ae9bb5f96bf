"""Trees grown best-first on histograms, for boosting and for classification.

Inputs are binned once. A pass over the rows adds up histograms for all nodes that may be split next, of all
trees that grow together; each node's best split comes back as one row. The driver keeps a queue of leaves
by gain. Which leaf is split next depends on gains alone, so the queue is replayed after every pass: the
passes look ahead (the children of all leaves that the remaining leaf budget could reach), and the tree is
the one that splitting a leaf at a time would give.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.models.stages import _Stage
from tablelab.session import materialize

MAX_BINS = 255
# Boosted trees after which the rows' scores are written anew, so that a pass never follows many trees.
SCORED_EVERY = 20
# Bytes of the histograms that a task fills in one pass; more nodes take more passes.
HISTOGRAM_BYTES = 1 << 26
# Splits of the trees that are looked up by all their comparisons at once.
MASKED_SPLITS = 10
# Fixed value: the least sum of second derivatives on either side of a split.
MIN_HESSIAN = 1e-3


# --- binning

def bin_edges(rows: DataFrame, size: int, most: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature of the array ``x`` the upper edges of its bins: midpoints of its values if there are at
    most ``most``, approximate quantiles otherwise. Tasks send a feature's values only up to that number."""
    schema = pa.schema([("feature", pa.int32()), ("value", pa.float64()), ("many", pa.bool_())])

    def distinct(batches):
        known = [np.empty(0)] * size
        for b in batches:
            x = _matrix(b.column("x"), size)
            for f in range(size):
                if len(known[f]) <= most:
                    known[f] = np.union1d(known[f], x[:, f])
        feature = np.repeat(np.arange(size), [min(len(k), most + 1) for k in known])
        many = np.repeat([len(k) > most for k in known], [min(len(k), most + 1) for k in known])
        yield pa.RecordBatch.from_arrays(
            [pa.array(feature, pa.int32()), pa.array(np.concatenate([k[:most + 1] for k in known])), pa.array(many)],
            schema=schema)

    values = materialize(
        rows.select("x").mapInArrow(distinct, "feature int, value double, many boolean")
        .groupBy("feature", "value").agg(F.max("many").alias("many")), "values")
    few = values.groupBy("feature").agg(F.count("*").alias("n"), F.max("many").alias("many")).filter(
        f"n <= {most} and not many").select("feature")
    edges: list = [None] * size
    for r in values.join(F.broadcast(few), "feature").groupBy("feature").agg(
            F.sort_array(F.collect_list("value")).alias("v")).collect():
        v = np.array(r["v"])
        edges[r["feature"]] = (v[:-1] + v[1:]) / 2
    wide = [f for f in range(size) if edges[f] is None]
    if wide:
        shares = [k / (most + 1) for k in range(1, most + 1)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 100_000).alias(f"f{f}") for f in wide]).first()
        for f in wide:
            edges[f] = np.unique(np.array(found[f"f{f}"] or [], float))
    return edges


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, size)


def _bins(column: pa.Array, size: int) -> np.ndarray:
    """Bin numbers of all rows, a column of the result for each input, read from the column's bytes at once."""
    if not len(column):
        return np.empty((0, size), np.uint8)
    width = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    begin, end = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * width.itemsize)[[0, -1]]
    rows = np.frombuffer(column.buffers()[2], np.uint8, int(end - begin), int(begin))
    return np.asfortranarray(rows.reshape(-1, size))


def binned(rows: DataFrame, edges: list[np.ndarray], label: str, scores: list[float]) -> DataFrame:
    """``(key, bins, y, raw)``, written: bin numbers of a row as bytes, and the scores it starts with."""
    size = len(edges)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), size)
            out = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)
            raw = np.tile(scores, len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([r.tobytes() for r in out], pa.binary()), b.column("y").cast(pa.int32()),
                 pa.ListArray.from_arrays(
                     np.arange(len(x) + 1, dtype=np.int32) * np.int32(len(scores)), pa.array(raw, pa.float64()))],
                names=["key", "bins", "y", "raw"])

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "x", F.col(label).alias("y"))
    return materialize(keyed.mapInArrow(run, "key long, bins binary, y int, raw array<double>"), "binned")


# --- trees

@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: list[float]
    right: list[float]


@dataclass
class Tree:
    """Nodes by number (children of ``i`` are ``2i + 1`` and ``2i + 2``): the best split of every node that was
    looked at, which of them are split, and the sums of each leaf."""

    known: dict[int, Split | None] = field(default_factory=dict)
    done: set[int] = field(default_factory=set)
    sums: dict[int, list[float]] = field(default_factory=dict)

    def route(self, bins: np.ndarray, through) -> np.ndarray:
        """Node of each row after the splits of the nodes ``through``."""
        node = np.zeros(len(bins), object if max(through, default=0) > 1 << 60 else np.int64)
        for n in sorted(through):  # parents come before their children
            at = np.flatnonzero(node == n)
            s = self.known[n]
            node[at] = 2 * n + 2 - (bins[at, s.feature] <= s.bin)
        return node


@dataclass
class Rules:
    max_leaves: int | None = None
    max_depth: int | None = None
    min_split: float = 2
    min_leaf: float = 1
    l2: float = 0.0

    def may_split(self, node: int, size: float) -> bool:
        deep = (node + 1).bit_length() - 1
        return size >= max(self.min_split, 2 * self.min_leaf) and (self.max_depth is None or deep < self.max_depth)


def replay(tree: Tree, rules: Rules, size: Callable[[list], float]) -> list[int]:
    """Splits leaves, the largest gain first, as far as gains are known; returns the nodes to look at next."""
    tree.done, tree.sums = set(), {0: tree.sums.get(0)}
    leaves, queue = 1, []

    def reach(node):
        s = tree.known.get(node)
        if s is not None:
            heapq.heappush(queue, (-s.gain, node))

    reach(0)
    while queue and (rules.max_leaves is None or leaves < rules.max_leaves):
        n = queue[0][1]
        unknown = [c for c in children(tree, n, rules, size) if c not in tree.known]
        if unknown:  # look ahead: whatever the rest of the budget could split
            budget = len(queue) if rules.max_leaves is None else rules.max_leaves - leaves
            ahead = [m for _, m in heapq.nsmallest(budget, queue)]
            return [c for m in ahead for c in children(tree, m, rules, size) if c not in tree.known]
        heapq.heappop(queue)
        tree.done.add(n)
        leaves += 1
        tree.sums.pop(n, None)
        tree.sums[2 * n + 1], tree.sums[2 * n + 2] = tree.known[n].left, tree.known[n].right
        if rules.max_leaves is None or leaves < rules.max_leaves:
            for c in children(tree, n, rules, size):
                reach(c)
    return []


def children(tree: Tree, node: int, rules: Rules, size) -> list[int]:
    """Children of a split that may be split themselves."""
    s = tree.known[node]
    return [c for c, sums in ((2 * node + 1, s.left), (2 * node + 2, s.right)) if rules.may_split(c, size(sums))]


def best_split(h: np.ndarray, rules: Rules, score: Callable, size: Callable) -> tuple | None:
    """``(gain, bin, left, right)`` of a histogram ``(bins, sums)``; the lowest bin among equals."""
    left, total = np.cumsum(h, 0)[:-1], h.sum(0)
    whole = float(score(total[None])[0])
    if not len(left) or not np.isfinite(whole):
        return None
    right = total - left
    gain = score(left) + score(right) - whole
    gain = np.where((size(left) >= rules.min_leaf) & (size(right) >= rules.min_leaf), gain, -np.inf)
    most = gain.max()
    if not most > 1e-12 * max(1.0, abs(whole)):
        return None
    k = int(np.argmax(gain > most * (1 - 1e-12)))
    return float(gain[k]), k, left[k].tolist(), right[k].tolist()


class Growth:
    """What a pass needs: the rows' sums per tree, and how sums are scored."""

    def __init__(self, edges, rules: Rules, seed: int = 0, subset: int | None = None):
        self.bins = [len(e) + 1 for e in edges]
        self.rules, self.seed, self.subset = rules, seed, subset

    def inputs(self, tree: int, node: int) -> set[int]:
        """Inputs that a node may be split by: all, or a drawn few of them."""
        if self.subset is None or self.subset >= len(self.bins):
            return set(range(len(self.bins)))
        draw = np.random.default_rng([self.seed, tree, node])
        return set(draw.choice(len(self.bins), self.subset, replace=False).tolist())

    def shared(self, raw) -> np.ndarray | None:
        """What the sums of all trees need of the rows' scores."""
        return None

    def sums(self, tree: int, key, y, shared) -> np.ndarray:
        """What each row adds to its node, a line for each sum."""
        raise NotImplementedError


class ClassCounts(Growth):
    """Classification trees; ``bootstrap`` weighs each tree's rows by a Poisson draw."""

    def __init__(self, edges, rules, classes: int, criterion: str, bootstrap: bool, **given):
        super().__init__(edges, rules, **given)
        self.classes, self.criterion, self.bootstrap = classes, criterion, bootstrap
        self.width = classes

    def sums(self, tree: int, key, y, shared) -> np.ndarray:
        out = np.zeros((self.classes, len(y)))
        out[y, np.arange(len(y))] = poisson(key, tree, self.seed) if self.bootstrap else 1.0
        return out

    def size(self, sums):
        return np.sum(sums, -1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        n = np.maximum(sums.sum(1), 1e-300)
        if self.criterion == "gini":
            return (sums ** 2).sum(1) / n - n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sums > 0, sums * np.log(sums / n[:, None]), 0.0).sum(1)


class Gradients(Growth):
    """Boosted trees: first and second derivatives of the log loss, and the number of rows."""

    width = 3

    def shared(self, raw) -> np.ndarray:
        return probabilities(raw)

    def sums(self, tree: int, key, y, p) -> np.ndarray:
        k = 1 if p.shape[1] == 2 else tree
        mine, hit = p[:, k], y == k
        return np.stack([mine - hit, mine * (1 - mine), np.ones(len(y))])

    def size(self, sums):
        return np.asarray(sums)[..., 2]

    def score(self, sums: np.ndarray) -> np.ndarray:
        enough = sums[:, 1] >= MIN_HESSIAN
        return np.where(enough, sums[:, 0] ** 2 / np.maximum(sums[:, 1] + self.rules.l2, 1e-300), -np.inf)

    def value(self, sums: list[float], rate: float) -> float:
        return -rate * sums[0] / max(sums[1] + self.rules.l2, 1e-300)


def probabilities(raw: np.ndarray) -> np.ndarray:
    """One score is the logit of the second class, several are those of a softmax."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw[:, 0]))
        return np.stack([1 - p, p], 1)
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def poisson(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A Poisson draw of mean 1 per row, the same whenever the row is read."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) & 0xFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    unit = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(steps, unit, "right").astype(float)


def grow(rows: DataFrame, growth: Growth, trees: list[Tree], rescore=None, first: int = 0) -> None:
    """Grows ``trees`` to their ends together. ``rescore(bins, raw)`` gives the rows' present scores."""
    need = {t: [0] for t in range(len(trees))}
    most = max(1, HISTOGRAM_BYTES // (8 * growth.width * sum(growth.bins)))
    while any(need.values()):
        asked = [(t, n) for t, nodes in need.items() for n in nodes]
        for begin in range(0, len(asked), most):
            _look(rows, growth, trees, asked[begin:begin + most], rescore, first)
        need = {t: replay(tree, growth.rules, growth.size) for t, tree in enumerate(trees) if need.get(t)}


def _look(rows: DataFrame, growth: Growth, trees: list[Tree], asked: list[tuple[int, int]], rescore, first: int) -> None:
    """One pass: best split of each asked ``(tree, node)``; a root's sums as well."""
    place: dict[int, dict[int, int]] = {}
    for k, (t, n) in enumerate(asked):
        place.setdefault(t, {})[n] = k
    through = {}
    for t, nodes in place.items():
        above: set[int] = set()
        for n in nodes:
            while n:
                n = (n - 1) // 2
                above.add(n)
        through[t] = above
    bins, width = growth.bins, growth.width
    offsets = np.concatenate([[0], np.cumsum(bins)])
    cells = int(offsets[-1])
    target = pa.schema([("asked", pa.int32()), ("feature", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def fill(batches):
        sums = np.zeros((len(asked), cells, width))
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            seen = True
            x = _bins(b.column("bins"), len(bins))
            key, y = np.asarray(b.column("key")), np.asarray(b.column("y"))
            raw = np.asarray(b.column("raw").flatten(), float).reshape(len(x), -1)
            if rescore is not None:
                raw = rescore(x, raw)
            shared = growth.shared(raw)
            for t, nodes in place.items():
                node = trees[t].route(x, through[t])
                mine = growth.sums(first + t, key, y, shared)
                for n, k in nodes.items():
                    at = np.flatnonzero(node == n)
                    part = mine[:, at] if len(at) < len(x) else mine
                    for f in range(len(bins)):
                        b_f = (x[at, f] if len(at) < len(x) else x[:, f]).astype(np.intp)
                        for w in range(width):
                            sums[k, offsets[f]:offsets[f + 1], w] += np.bincount(b_f, part[w], minlength=bins[f])
        if seen:
            for k in range(len(asked)):
                yield pa.RecordBatch.from_pylist(
                    [{"asked": k, "feature": f, "sums": sums[k, offsets[f]:offsets[f + 1]].ravel()}
                     for f in range(len(bins))], schema=target)

    def best(frames):
        held: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for k, f, s in zip(frame["asked"], frame["feature"], frame["sums"]):
                h = np.asarray(s, float).reshape(-1, width)
                held[k, f] = held[k, f] + h if (k, f) in held else h
        out = []
        for (k, f), h in held.items():
            t, n = asked[k]
            s = best_split(h, growth.rules, growth.score, growth.size) if f in growth.inputs(first + t, n) else None
            out.append((k, f, *(s or (None, None, None, None)), h.sum(0).tolist() if f == 0 else None))
        yield pd.DataFrame(out, columns=["asked", "feature", "gain", "bin", "left", "right", "total"])

    filled = rows.mapInArrow(fill, "asked int, feature int, sums array<double>")
    split = filled.repartition("asked", "feature").mapInPandas(
        best, "asked int, feature int, gain double, bin int, left array<double>, right array<double>, total array<double>")
    # gains that differ by rounding alone are equal: the first input is taken
    rank = F.struct(F.round(F.col("gain"), 9), -F.col("feature"))
    found = split.groupBy("asked").agg(
        F.max_by(F.struct("gain", "feature", "bin", "left", "right"), F.when(F.col("gain").isNotNull(), rank)).alias("s"),
        F.max("total").alias("total")).collect()  # one row per asked node
    for t, n in asked:
        trees[t].known[n] = None
    for r in found:
        t, n = asked[r["asked"]]
        if n == 0:
            trees[t].sums[0] = list(r["total"])
        s = r["s"]
        if s is not None and s["gain"] is not None and growth.rules.may_split(n, growth.size(r["total"])):
            trees[t].known[n] = Split(s["gain"], s["feature"], s["bin"], list(s["left"]), list(s["right"]))


def plain(tree: Tree, edges, value: Callable) -> dict:
    """A tree as lists: input, threshold, children and value of each node, numbered from 0."""
    nodes = sorted(tree.done | set(tree.sums))
    number = {n: i for i, n in enumerate(nodes)}
    out: dict = {"feature": [], "bin": [], "at": [], "left": [], "right": [], "value": []}
    for n in nodes:
        s = tree.known[n] if n in tree.done else None
        out["feature"].append(s.feature if s else -1)
        out["bin"].append(s.bin if s else 0)
        out["at"].append(float(edges[s.feature][s.bin]) if s else 0.0)
        out["left"].append(number[2 * n + 1] if s else -1)
        out["right"].append(number[2 * n + 2] if s else -1)
        out["value"].append(value(tree.sums[n]) if not s else None)
    return out


def leaf_of(tree: dict, x: np.ndarray, by: str = "at") -> np.ndarray:
    """Leaf of each row, by real inputs or by bins."""
    feature, at = np.array(tree["feature"]), np.array(tree[by])
    left, right = np.array(tree["left"]), np.array(tree["right"])
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[node] >= 0)
        if not len(inner):
            return node
        n = node[inner]
        node[inner] = np.where(x[inner, feature[n]] <= at[n], left[n], right[n])


def add_scores(x: np.ndarray, raw: np.ndarray, trees: list[list[dict]], by: str) -> np.ndarray:
    """Scores with the values of boosted trees (per round, one per score) added."""
    raw = np.asfortranarray(raw.copy())
    for round_ in trees:
        for k, t in enumerate(round_):
            values = np.array([v or 0.0 for v in t["value"]])
            inner = sum(f >= 0 for f in t["feature"])
            if by == "bin" and inner <= MASKED_SPLITS:
                raw[:, k] += _masked(x, t, values)
            else:
                raw[:, k] += values[leaf_of(t, x, by)]
    return raw


def _masked(x: np.ndarray, tree: dict, values: np.ndarray) -> np.ndarray:
    """Values of a small tree by bins: the splits a row passes to the right make a number, each of which has a leaf."""
    inner = [n for n, f in enumerate(tree["feature"]) if f >= 0]
    passed = np.zeros(len(x), np.uint16)
    for f in sorted({tree["feature"][n] for n in inner}):
        of_bin = np.zeros(256, np.uint16)
        for bit, n in enumerate(inner):
            if tree["feature"][n] == f:
                of_bin[tree["bin"][n] + 1:] |= np.uint16(1 << bit)
        passed |= of_bin[x[:, f]]
    numbers = np.arange(1 << len(inner))
    node = np.zeros(len(numbers), np.int64)
    for bit, n in enumerate(inner):  # parents come before their children
        right = (numbers >> bit) & 1
        node = np.where(node == n, np.where(right, tree["right"][n], tree["left"][n]), node)
    return values[node][passed]


# --- fits

def _rows(df: DataFrame, features: str, label: str) -> tuple[DataFrame, int]:
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("int").alias(label))
    return rows, len(rows.select("x").head()[0])


def boost(df: DataFrame, features: str, label: str, classes: int, rounds: int, rate: float, rules: Rules) -> str:
    """Gradient boosting on the log loss: one tree a round for two classes, one per class for more."""
    rows, size = _rows(df, features, label)
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    shares = np.clip([counts.get(c, 0) / n for c in range(classes)], 1e-12, 1 - 1e-12)
    start = [float(np.log(shares[1] / shares[0]))] if classes == 2 else np.log(shares).tolist()
    edges = bin_edges(rows, size)
    table = binned(rows, edges, label, start)
    growth, done = Gradients(edges, rules), []
    for r in range(rounds):
        recent = done[r - r % SCORED_EVERY:]
        if r and not recent:
            table = _rescored(table, done[r - SCORED_EVERY:], size)

        def rescore(x, raw, recent=recent):
            return add_scores(x, raw, recent, "bin")

        trees = [Tree() for _ in start]
        grow(table, growth, trees, rescore)
        done.append([plain(t, edges, lambda s: growth.value(s, rate)) for t in trees])
    return json.dumps({"start": start, "rounds": done})


def _rescored(table: DataFrame, trees: list[list[dict]], size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            x = _bins(b.column("bins"), size)
            raw = np.asarray(b.column("raw").flatten(), float).reshape(len(x), -1)
            new = add_scores(x, raw, trees, "bin")
            raws = pa.ListArray.from_arrays(np.arange(0, new.size + 1, new.shape[1], dtype=np.int32), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("bins"), b.column("y"), raws],
                                             names=["key", "bins", "y", "raw"])

    return materialize(table.mapInArrow(run, table.schema), "scores")


def forest(df: DataFrame, features: str, label: str, classes: int, n: int, criterion: str, rules: Rules,
           bootstrap: bool, subset: str | int | None, seed: int) -> str:
    """Classification trees that grow together, as many as fit a pass; shares of the leaves are averaged."""
    rows, size = _rows(df, features, label)
    edges = bin_edges(rows, size)
    table = binned(rows, edges, label, [])
    inputs = {None: None, "sqrt": max(1, int(size ** 0.5)), "log2": max(1, int(np.log2(size)))}.get(subset, subset)
    growth = ClassCounts(edges, rules, classes, criterion, bootstrap, seed=seed, subset=inputs)
    together = max(1, HISTOGRAM_BYTES // (8 * classes * sum(growth.bins) * 8))
    done = []
    for first in range(0, n, together):
        trees = [Tree() for _ in range(min(together, n - first))]
        grow(table, growth, trees, first=first)
        done += [[plain(t, edges, lambda s: [v / max(sum(s), 1e-300) for v in s])] for t in trees]
    return json.dumps({"start": [0.0] * classes, "forest": done})


class GrownTrees(_Stage):
    """Scores with trees of ``boost`` or ``forest``; adds a vector of class probabilities."""

    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, trees=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, dataset):
        model = json.loads(self.getOrDefault(self.trees))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(x: pd.Series) -> pd.Series:
            block = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            start = np.tile(model["start"], (len(block), 1))
            if "rounds" in model:
                return pd.Series(list(probabilities(add_scores(block, start, model["rounds"], "at"))))
            for (t,) in model["forest"]:
                values = np.array([v or [0.0] * start.shape[1] for v in t["value"]])
                start += values[leaf_of(t, block)]
            return pd.Series(list(start / len(model["forest"])))

        values = scored(vector_to_array(F.col(self.getOrDefault(self.inputCol))))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(values))
