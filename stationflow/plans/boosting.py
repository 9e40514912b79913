"""Boosted trees by second-order histograms, grown by depth or by leaf.

Values become bins at the quantiles of a sketch, once; a row is then a few bytes, its label and its margin. Rows are
dealt evenly to all cores and kept in packed blocks, so that a pass reads arrays and no single rows. For
a set of leaves, one grouped aggregation adds gradients, hessians and rows by (leaf, feature, bin): tasks
add up their own rows and the sums of a leaf and a feature meet in one task. The driver holds these sums only
(leaves x features x bins, whatever the rows are), finds the splits, and gets a sibling's sums by subtracting the
smaller child from the parent, so that only the smaller half of the rows is added up.

* ``growth="depth"``: all leaves of a level are split, one aggregation a level.
* ``growth="leaf"``: the leaf with the largest gain is split next, until there are ``max_leaves``. An aggregation adds up for all leaves that may
  be split next, so a tree takes about as many as it is deep.

Margins are kept with the rows; the last trees are evaluated on the fly and folded in every ``REFRESH`` rounds.
Rows are sampled by a hash of their content and the round, so that a repeated task draws the same ones; features by a seeded draw for each
tree. Missing values (NULL or NaN) have a bin of their own and go to the side where they gain more. Ties between splits go to the earlier
feature, then the smaller bin, then missing values to the left.
"""

from __future__ import annotations

import copy
import heapq
import itertools
import random
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds after which the margins are written anew, and the error of the quantile sketch.
REFRESH, SKETCH_ERROR = 4, 1e-3
#: Rows that are worth a task of their own, and the most of one task.
BLOCK, MOST = 10_000, 500_000


@dataclass(frozen=True)
class Params:
    """``min_child_weight`` bounds a side's hessian (for squared loss: its rows); ``validation`` names a flag column, on whose rows the absolute error must improve every ``stop_after`` rounds."""

    rounds: int = 100
    learning_rate: float = 0.1
    growth: str = "depth"
    max_depth: int = 6
    max_leaves: int = 31
    min_child_weight: float = 1.0
    min_child_rows: int = 1
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    bins: int = 255
    validation: str | None = None
    stop_after: int = 10
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: the feature (-1 in a leaf), the last bin and value that go left, children, side of missing values, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float, missing_left: bool) -> tuple[int, int]:
        n = len(self.feature)
        for x, empty in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.missing_left, True), (self.value, 0.0)):
            x += [empty, empty]
        self.feature[node], self.bin[node], self.threshold[node], self.left[node], self.right[node], self.missing_left[node] = feature, cut, threshold, n, n + 1, missing_left
        return n, n + 1

    def above(self, leaves: list[int]) -> np.ndarray:
        """Whether a node is one of these leaves or above one."""
        over = {c: i for i, f in enumerate(self.feature) if f >= 0 for c in (self.left[i], self.right[i])}
        found = np.zeros(len(self.feature), bool)
        for x in leaves:
            found[x] = True
            while x in over:
                x = over[x]
                found[x] = True
        return found

    def leaves(self, values: np.ndarray, binned: bool, only: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of bins (or of raw values); rows that leave the nodes of ``only`` go no further."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        limit, lost = np.array(self.bin if binned else self.threshold), np.array(self.missing_left)
        node = np.zeros(len(values), np.int64)
        live = np.arange(len(values)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            at = node[live]
            v = values[live, feature[at]]
            missing = v == 0 if binned else np.isnan(v)
            node[live] = np.where(np.where(missing, lost[at], v <= limit[at]), left[at], right[at])
            live = live[feature[node[live]] >= 0]
            if only is not None:
                live = live[only[node[live]]]
        return node

    def predict(self, values: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value)[self.leaves(values, binned)]


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(sums: np.ndarray, p: Params) -> float:
    """The step of least second-order loss from (gradient, hessian, rows)."""
    return float(-p.learning_rate * _shrunk(sums[0], p.reg_alpha) / (sums[1] + p.reg_lambda)) if sums[1] + p.reg_lambda > 0 else 0.0


def best_split(histogram: np.ndarray, used: list[int], sizes: list[int], p: Params) -> Split | None:
    """The split of largest gain from a leaf's sums (feature x bin x (gradient, hessian, rows)); None if none gains."""
    best = None
    score = lambda s: _shrunk(s[..., 0], p.reg_alpha) ** 2 / np.maximum(s[..., 1] + p.reg_lambda, 1e-12)
    for f in used:
        h = histogram[f, : sizes[f]]
        total, upto, missing = h.sum(0), np.cumsum(h[1:-1], axis=0), h[0]
        if not len(upto):
            continue
        for to_left in (True, False) if missing[2] > 0 else (True,):
            left = upto + missing if to_left else upto
            right = total - left
            gain = 0.5 * (score(left) + score(right) - score(total)) - p.gamma
            open_ = (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight) & (left[:, 2] >= p.min_child_rows) & (right[:, 2] >= p.min_child_rows)
            gain = np.where(open_, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best.gain + 1e-12):
                best = Split(float(gain[k]), f, k + 1, to_left, left[k], right[k])
    return best


def _mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) by a hash of the row and a salt."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
        return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) / 2.0**53


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: its distinct quantiles."""
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features])
    found = clean.approxQuantile(features, [i / bins for i in range(1, bins)], SKETCH_ERROR)
    return [np.unique(np.array(q, float)) for q in found]


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """0 for a missing value, else 1 and the number of edges below the value."""
    out = np.empty(values.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(values[:, f]), 0, np.searchsorted(e, values[:, f], side="left") + 1)
    return out


#: A block of rows in each: arrays as bytes.
_ROWS = "bins binary, id binary, y binary, held binary, margin binary"


class Rows:
    """The binned training rows with their margins, and the aggregations over them."""

    def __init__(self, df: DataFrame, features: list[str], label: str, edges: list[np.ndarray], p: Params):
        self.edges, self.n_features, self.p = edges, len(features), p
        self.sizes = [len(e) + 2 for e in edges]
        self.width = max(self.sizes, default=2)
        held = F.col(p.validation).cast("boolean") if p.validation else F.lit(False)
        known = df.where(F.col(label).isNotNull())
        chosen = known.select(*[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)], F.xxhash64(*known.columns).alias("id"), F.col(label).cast("double").alias("y"), F.coalesce(held, F.lit(False)).alias("held"))
        first, n = known.agg(F.avg(F.when(~F.coalesce(held, F.lit(False)), F.col(label).cast("double"))), F.count("*")).first()
        self.base = float(first) if first is not None else 0.0
        # a cached or aggregated table may lie in few partitions
        tasks = max(1, -(-n // MOST), min(df.sparkSession.sparkContext.defaultParallelism, n // BLOCK))
        self.state = chosen.repartition(tasks, "id").mapInArrow(lambda x, start=self.base: _binned(x, edges, start), _ROWS).persist()
        self.pending: list[Tree] = []

    def release(self) -> None:
        self.state.unpersist()

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        if len(self.pending) == REFRESH:
            old, trees, n = self.state, self.pending, self.n_features
            self.state = old.mapInArrow(lambda x: _moved(x, trees, n), _ROWS).persist()
            self.state.count()
            old.unpersist()
            self.pending = []

    def histograms(self, tree: Tree, leaves: list[int], turn: int) -> tuple[dict[int, np.ndarray], tuple[float, float]]:
        """Sums of the given leaves of a tree (feature x bin x 3), and, before its first split, (absolute errors, rows) of the validation rows."""
        trees, n, width, p = list(self.pending), self.n_features, self.width, self.p
        first, path = len(tree.feature) == 1, tree.above(leaves)

        def run(batches) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(leaves), n, width, 3))
            place = np.full(len(tree.feature), -1)
            place[leaves] = np.arange(len(leaves))
            error = np.zeros(2)
            for bins, ids, y, held, margin in _unpacked(batches, n):
                take = ~held
                if p.subsample < 1:
                    take &= _mixed(ids, turn + p.seed) < p.subsample
                mine = np.flatnonzero(take)
                at = place[tree.leaves(bins[mine], True, path)]
                mine, at = mine[at >= 0], at[at >= 0]
                asked = slice(None) if first else mine  # of other rows the margin is not needed
                bins, y, held, margin = bins[asked], y[asked], held[asked], margin[asked]
                for t in trees:
                    margin = margin + t.predict(bins, True)
                error += np.abs(margin - y)[held].sum(), held.sum()
                g = margin - y  # of half the squared error; its second derivative is 1
                if first:
                    bins, g = bins[mine], g[mine]
                for f in range(n):
                    key = at * width + bins[:, f]
                    counts = np.bincount(key, minlength=len(leaves) * width)
                    both = np.stack([np.bincount(key, g, len(leaves) * width), counts, counts], -1)
                    total[:, f] += both.reshape(len(leaves), width, 3)
            keys = [(leaves[i], f) for i in range(len(leaves)) for f in range(n)]
            blobs = [total[i, f].tobytes() for i in range(len(leaves)) for f in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys] + [-1], pa.int64()), pa.array([k[1] for k in keys] + [-1], pa.int64()), pa.array([*blobs, error.tobytes()], pa.binary())], ["leaf", "feature", "sums"])

        def merge(batches) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for *k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    v = np.frombuffer(s)
                    held[tuple(k)] = held[tuple(k)] + v if tuple(k) in held else v
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["leaf", "feature", "sums"])

        schema = "leaf bigint, feature bigint, sums binary"
        got = self.state.mapInArrow(run, schema).repartition("leaf", "feature").mapInArrow(merge, schema).toArrow()
        out = {leaf: np.zeros((n, width, 3)) for leaf in leaves}
        error = np.zeros(2)
        for leaf, f, s in zip(*(c.to_pylist() for c in got.columns), strict=True):
            if leaf < 0:
                error += np.frombuffer(s)
            else:
                out[leaf][f] += np.frombuffer(s).reshape(width, 3)
        return out, (float(error[0]), float(error[1]))


def _binned(batches, edges: list[np.ndarray], start: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.column_stack([b.column(f"_f{i}").to_numpy(zero_copy_only=False) for i in range(len(edges))]) if edges else np.zeros((b.num_rows, 0))
        bins = to_bins(values.astype(float), edges)
        held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
        yield _packed(bins, b.column("id").to_numpy(), b.column("y").to_numpy(), held, np.full(b.num_rows, start))


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["bins", "id", "y", "held", "margin"])


def _unpacked(batches, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for bins, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids, y, held, margin = (np.frombuffer(x, t) for x, t in zip(rest, (np.int64, float, bool, float), strict=True))
            yield np.frombuffer(bins, np.uint8).reshape(len(y), n), ids, y, held, margin


def _moved(batches, trees: list[Tree], n: int) -> Iterator[pa.RecordBatch]:
    for bins, ids, y, held, margin in _unpacked(batches, n):
        for t in trees:
            margin = margin + t.predict(bins, True)
        yield _packed(bins, ids, y, held, margin)


def grow(rows: Rows, used: list[int], turn: int) -> tuple[Tree, tuple[float, float]]:
    """One tree, and the validation error of the trees before it."""
    p, tree = rows.p, Tree()
    first, error = rows.histograms(tree, [0], turn)
    sums, depth = {0: first[0]}, {0: 0}
    totals = {0: first[0][0].sum(0)}
    order = itertools.count()
    queue: list[tuple[float, int, int, Split]] = []

    def offer(leaf: int) -> None:
        if p.max_depth < 0 or depth[leaf] < p.max_depth:
            found = best_split(sums[leaf], used, rows.sizes, p)
            if found:
                heapq.heappush(queue, (-found.gain, next(order), leaf, found))
                return
        del sums[leaf]

    ahead: dict[int, np.ndarray] = {}

    def look(entries: list[tuple[float, int, int, Split]]) -> None:
        """Adds up the smaller half that each leaf will be split into."""
        trial, halves = copy.deepcopy(tree), {}
        for _, _, leaf, s in entries:
            a, b = trial.split(leaf, s.feature, s.cut, float(rows.edges[s.feature][s.cut - 1]), s.missing_left)
            halves[leaf] = a if s.left[2] <= s.right[2] else b
        found = rows.histograms(trial, list(halves.values()), turn)[0]
        ahead.update({leaf: found[node] for leaf, node in halves.items()})

    offer(0)
    n_leaves = 1
    while queue and (p.growth == "depth" or n_leaves < p.max_leaves):
        # by depth: the whole level; by leaf: the best one
        chosen = [heapq.heappop(queue) for _ in range(len(queue) if p.growth == "depth" else 1)]
        left = p.max_leaves - n_leaves - 1  # splits after this one, by leaf
        chosen.sort(key=lambda x: x[1])
        deep = lambda entry: p.max_depth >= 0 and depth[entry[2]] + 1 >= p.max_depth  # noqa: E731  its halves stay leaves
        last = p.growth == "leaf" and not left
        if not last and any(x[2] not in ahead and not deep(x) for x in chosen):
            more = heapq.nsmallest(left - 1, queue) if p.growth == "leaf" else []  # these may be split next
            look([x for x in [*chosen, *more] if x[2] not in ahead and not deep(x)])
        pairs = []
        for _, _, leaf, s in chosen:
            a, b = tree.split(leaf, s.feature, s.cut, float(rows.edges[s.feature][s.cut - 1]), s.missing_left)
            depth[a] = depth[b] = depth[leaf] + 1
            totals[a], totals[b] = s.left, s.right
            n_leaves += 1
            pairs.append((leaf, *((a, b) if s.left[2] <= s.right[2] else (b, a))))
        for leaf, small, large in pairs:
            whole = sums.pop(leaf)
            if leaf in ahead and not last:
                half = ahead.pop(leaf)
                sums[small], sums[large] = half, whole - half
                for leaf_of in sorted((small, large)):
                    offer(leaf_of)
    for node, f in enumerate(tree.feature):
        if f < 0:
            tree.value[node] = leaf_value(totals[node], p)
    return tree, error


@dataclass
class BoostedModel:
    features: list[str]
    base: float
    trees: list[Tree]
    errors: list[float]

    def transform(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        """The rows with their prediction."""
        features, base, trees = self.features, self.base, self.trees
        own = [f"_f{i}" for i in range(len(features))]

        def run(batches):
            for b in batches:
                values = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in own])
                total = np.full(b.num_rows, base)
                for t in trees:
                    total += t.predict(values)
                kept = [c for c in b.schema.names if c not in own and c != name]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(total)], [*kept, name])

        rest = df.drop(name)
        each: list[Column] = [F.col(c).cast("double").alias(n) for c, n in zip(features, own, strict=True)]
        return df.select(*rest.columns, *each).mapInArrow(run, rest.schema.add(name, "double"))


@dataclass(frozen=True)
class Boosting:
    """Fits ``label`` from ``features``; see ``Params``."""

    features: list[str]
    label: str
    params: Params = Params()

    def fit(self, train: DataFrame) -> BoostedModel:
        p = self.params
        rows = Rows(train, self.features, self.label, bin_edges(train, self.features, p.bins), p)
        trees: list[Tree] = []
        errors: list[float] = []
        try:
            for turn in range(p.rounds):
                rng = random.Random(p.seed * 1_000_003 + turn)
                every = list(range(len(self.features)))
                used = sorted(rng.sample(every, max(1, round(p.colsample * len(every))))) if p.colsample < 1 else every
                tree, (error, n) = grow(rows, used, turn)
                if p.validation and n:
                    errors.append(error / n)
                    if len(errors) - 1 - int(np.argmin(errors)) >= p.stop_after:
                        break
                if tree.feature[0] < 0 and p.subsample >= 1 and p.colsample >= 1:
                    break  # nothing gains any more
                trees.append(tree)
                rows.add(tree)
            if p.validation and errors:
                if len(errors) == len(trees):  # the last tree's error is not known yet
                    _, (error, n) = rows.histograms(Tree(), [], 0)
                    errors.append(error / n)
                trees = trees[: int(np.argmin(errors))]
        finally:
            rows.release()
        return BoostedModel(self.features, rows.base, trees, errors)


# The two published ways of growth.
PRESETS = {"depth": {"growth": "depth", "max_depth": 6}, "leaf": {"growth": "leaf", "max_depth": -1, "max_leaves": 31, "min_child_rows": 20, "min_child_weight": 1e-3}}


def boosting(features: list[str], label: str, preset: str = "depth", **params) -> Boosting:
    known = {f.name for f in fields(Params)}
    if unknown := params.keys() - known:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    return Boosting(features, label, Params(**{**PRESETS[preset], **params}))
