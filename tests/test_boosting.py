import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.plans import boosting


def table(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + x[:, 1] ** 2 + rng.normal(0, 0.2, n)
    x[rng.random((n, 3)) < 0.05] = np.nan
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r), float(t), bool(i % 4 == 0)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, held boolean").repartition(4), x, y


FEATURES = ["a", "b", "c"]


def shrunk(g, alpha):
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def plain_split(x, g, edges, p):
    """All cuts of all features by loops over rows."""
    best = None
    for f in range(x.shape[1]):
        v, missing = x[:, f], np.isnan(x[:, f])
        for to_left in (True, False) if missing.any() else (True,):
            for k, e in enumerate(edges[f]):
                left = np.where(missing, to_left, v <= e)
                if min(left.sum(), (~left).sum()) < max(p.min_child_rows, p.min_child_weight):
                    continue
                score = lambda s: shrunk(g[s].sum(), p.reg_alpha) ** 2 / (s.sum() + p.reg_lambda)
                gain = 0.5 * (score(left) + score(~left) - score(np.ones(len(g), bool))) - p.gamma
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, k, to_left, left
    return best


def plain_tree(x, g, edges, p):
    """(rows, splits in order) of a tree: leaves as row masks."""
    leaves, splits, value = [(np.ones(len(g), bool), 0)], [], {}
    if p.growth == "leaf":
        while len(leaves) < p.max_leaves:
            found = [(plain_split(x[m], g[m], edges, p), i) for i, (m, d) in enumerate(leaves) if p.max_depth < 0 or d < p.max_depth]
            found = [f for f in found if f[0]]
            if not found:
                break
            best, i = max(found, key=lambda t: t[0][0])
            leaves, splits = divide(leaves, i, best, splits)
    else:
        for depth in range(p.max_depth):
            for i in [i for i, (_, d) in enumerate(leaves) if d == depth][::-1]:
                best = plain_split(x[leaves[i][0]], g[leaves[i][0]], edges, p)
                if best:
                    leaves, splits = divide(leaves, i, best, splits)
    step = np.zeros(len(g))
    for m, _ in leaves:
        step[m] = -p.learning_rate * shrunk(g[m].sum(), p.reg_alpha) / (m.sum() + p.reg_lambda)
    del value
    return step, sorted(splits)


def divide(leaves, i, best, splits):
    m, d = leaves[i]
    rows = np.flatnonzero(m)
    a, b = np.zeros_like(m), np.zeros_like(m)
    a[rows[best[4]]], b[rows[~best[4]]] = True, True
    return leaves[:i] + [(a, d + 1), (b, d + 1)] + leaves[i + 1 :], [*splits, (best[1], best[2] + 1, best[3], int(a.sum()), int(b.sum()))]


@pytest.mark.parametrize("more", [
    {"growth": "depth", "max_depth": 3}, {"growth": "depth", "max_depth": 4, "reg_alpha": 2.0, "reg_lambda": 0.5, "gamma": 0.5, "min_child_rows": 9},
    {"growth": "leaf", "max_depth": -1, "max_leaves": 7, "min_child_rows": 5}, {"growth": "leaf", "max_depth": 3, "max_leaves": 9, "min_child_weight": 20.0},
])
def test_splits_equal_plain_loops(spark, more):
    df, x, y = table(spark)
    p = boosting.Params(rounds=3, learning_rate=0.3, bins=16, **more)
    edges = boosting.bin_edges(df, FEATURES, p.bins)
    model = boosting.Boosting(FEATURES, "y", p).fit(df)
    margin = np.full(len(y), y.mean())
    assert math.isclose(model.base, y.mean()) and len(model.trees) == 3
    for tree in model.trees:
        step, splits = plain_tree(x, margin - y, edges, p)
        at = [i for i, f in enumerate(tree.feature) if f >= 0]
        bins = boosting.to_bins(x, edges)
        reach = {0: np.ones(len(y), bool)}
        for i in at:
            v = bins[:, tree.feature[i]]
            left = np.where(v == 0, tree.missing_left[i], v <= tree.bin[i])
            reach[tree.left[i]], reach[tree.right[i]] = reach[i] & left, reach[i] & ~left
        got = sorted((tree.feature[i], tree.bin[i], tree.missing_left[i], int(reach[tree.left[i]].sum()), int(reach[tree.right[i]].sum())) for i in at)
        assert got == splits and np.allclose(tree.predict(x), step) and np.allclose(tree.predict(bins, True), step)
        margin = margin + step
    back = {r["id"]: r["y_pred"] for r in model.transform(df).collect()}
    assert np.allclose([back[i] for i in range(len(y))], margin)


def test_margins_that_are_written_anew_change_nothing(spark, monkeypatch):
    df, _, _ = table(spark)
    fit = lambda: boosting.boosting(FEATURES, "y", rounds=5, max_depth=2, bins=16).fit(df)
    whole = fit()
    monkeypatch.setattr(boosting, "REFRESH", 2)
    again = fit()
    assert [t.feature for t in whole.trees] == [t.feature for t in again.trees] and np.allclose([t.value[-1] for t in whole.trees], [t.value[-1] for t in again.trees])


def test_sampling_repeats_and_early_stopping_keeps_the_best_round(spark):
    df, _, _ = table(spark)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    fit = lambda seed: boosting.boosting(FEATURES, "y", preset="leaf", rounds=4, max_leaves=4, bins=16, subsample=0.6, colsample=0.67, seed=seed).fit(df)
    a, b, c = fit(1), fit(1), fit(2)
    assert [t.bin for t in a.trees] == [t.bin for t in b.trees] != [t.bin for t in c.trees]
    noise = df.withColumn("y", F.when(F.col("held"), F.rand(3) * 100).otherwise(F.col("y")))
    stopped = boosting.boosting(FEATURES, "y", rounds=12, max_depth=2, bins=16, learning_rate=1.0, validation="held", stop_after=2).fit(noise)
    assert len(stopped.errors) < 13 and len(stopped.trees) == int(np.argmin(stopped.errors)) and len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_constant_labels_empty_tables_and_extra_columns(spark):
    df, _, _ = table(spark)
    flat = boosting.boosting(FEATURES, "y", rounds=3).fit(df.withColumn("y", F.lit(2.0)))
    assert flat.trees == [] and {r[0] for r in flat.transform(df.withColumn("y_pred", F.lit("x"))).select("y_pred").collect()} == {2.0}
    none = boosting.boosting(FEATURES, "y", rounds=2).fit(df.where("false"))
    assert none.trees == [] and none.transform(df.where("false")).count() == 0
    with pytest.raises(TypeError):
        boosting.boosting(FEATURES, "y", depth=3)


def test_it_learns_better_than_a_line(spark):
    df, _, y = table(spark, 600, 9)
    model = boosting.boosting(FEATURES, "y", rounds=25, max_depth=4, learning_rate=0.3, bins=64).fit(df.where("NOT held"))
    rmse = model.transform(df.where("held")).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)))).first()[0]
    assert rmse < 0.4 * y.std()


def test_a_tree_grown_by_leaf_takes_a_pass_a_level_and_rows_are_dealt_in_blocks(spark, monkeypatch):
    df, _, _ = table(spark)
    passes, tasks, whole = [], [], boosting.Rows.histograms
    monkeypatch.setattr(boosting, "BLOCK", 50)
    monkeypatch.setattr(boosting, "MOST", 60)
    monkeypatch.setattr(boosting.Rows, "histograms", lambda self, *x: (passes.append(x[1]), tasks.append((self.state.rdd.getNumPartitions(), self.state.count())), whole(self, *x))[2])
    tree = boosting.boosting(FEATURES, "y", preset="leaf", rounds=1, max_leaves=9, min_child_rows=5, bins=16).fit(df.coalesce(1)).trees[0]
    assert tree.feature.count(-1) == 9 and len(passes) < 8  # 8 splits
    assert tasks[0][0] == 5 and tasks[0][1] <= 5  # 300 rows in tasks of 60 each, a block in each
