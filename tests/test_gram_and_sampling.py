import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.operators import sampling
from stationflow.plans import gram, models, queries


def table(spark, n=400, seed=3, p=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 10, 0.1][:p]
    y1, y2 = x @ [2.0, -0.3, 5.0][:p] + 1 + rng.normal(0, 0.5, n), np.sin(x[:, 0]) + rng.normal(0, 0.1, n)
    rows = []
    for i in range(n):
        f = [None if rng.random() < 0.03 else float(v) for v in x[i]]
        rows.append((("AT", "BE", "FR")[i % 3], f"s{i % 7}", 1_704_067_200 + 3600 * (i // 7), *f, None if i % 11 == 0 else float(y1[i]), None if i % 13 == 0 else float(y2[i])))
    df = spark.createDataFrame(rows, "country string, site_number string, t long, a double, b double, c double, y_h1 double, y_h3 double").withColumn("ts", F.timestamp_seconds("t"))
    return df.repartition(5), rows


FEATURES = ["a", "b", "c"]


def local(rows, label, keep=lambda r: True):
    at = {"y_h1": 6, "y_h3": 7}[label]
    chosen = [r for r in rows if keep(r) and all(v is not None for v in r[3:6]) and r[at] is not None]
    return np.array([[*r[3:6], 1.0] for r in chosen]), np.array([r[at] for r in chosen])


def test_sums_are_those_of_numpy_by_group(spark):
    df, rows = table(spark)
    form = gram.Linear(tuple(FEATURES))
    found = gram.sums(df, [form], ["y_h1", "y_h3"], ("country",))
    for label in ("y_h1", "y_h3"):
        for c in ("AT", "BE", "FR"):
            x, y = local(rows, label, lambda r, c=c: r[0] == c)
            g = found.found[0, label, c]
            assert g.n == len(y) and np.allclose(g.xx, x.T @ x) and np.allclose(g.xy, x.T @ y) and math.isclose(g.yy, y @ y)
        # a left-out country is subtracted
        x, y = local(rows, label, lambda r: r[0] != "BE")
        rest = found.total(0, label) - found.found[0, label, "BE"]
        assert np.allclose(rest.solve(form), np.linalg.lstsq(x, y, rcond=None)[0]) and math.isclose(rest.squared_error(rest.solve(form)), ((x @ rest.solve(form) - y) ** 2).mean(), rel_tol=1e-9)


@pytest.mark.parametrize("lam", [0.0, 0.01, 1.0, 100.0])
def test_ridge_and_splines_against_numpy(spark, lam):
    df, rows = table(spark)
    form = gram.Linear(tuple(FEATURES))
    x, y = local(rows, "y_h1")
    extra = np.sqrt(lam * ((x[:, :3] - x[:, :3].mean(0)) ** 2).sum(0))
    expected = np.linalg.lstsq(np.vstack([x, np.column_stack([np.diag(extra), np.zeros(3)])]), np.append(y, np.zeros(3)), rcond=None)[0]
    assert np.allclose(gram.sums(df, [form], ["y_h1"]).total(0, "y_h1").solve(form, lam), expected, rtol=1e-6)
    smooth = gram.splines(df, FEATURES, 9)
    b = smooth.matrix(x[:, :3])
    assert np.allclose(b.reshape(len(b), 3, 9).sum(2), 1) and ((b > 1e-12).reshape(len(b), 3, 9).sum(2) <= 4).all()
    w = gram.sums(df, [smooth], ["y_h1"]).total(0, "y_h1").solve(smooth, lam)
    second = np.sqrt(lam) * np.kron(np.eye(3), np.diff(np.eye(9), 2, axis=0))
    plain = np.linalg.lstsq(np.vstack([b, second]), np.append(y, np.zeros(len(second))), rcond=None)[0]
    assert np.allclose(b @ w, b @ plain, atol=1e-3)


def test_splines_equal_the_fitted_pipeline(spark):
    df, _ = table(spark)
    df = df.dropna()
    piped = models.additive(FEATURES, "y_h1", n_splines=8, lam=0.7).fit(df).transform(df).select("t", "site_number", F.col("y_pred").alias("other"))
    form, lam = models.design(df, FEATURES, models.additive, n_splines=8, lam=0.7)
    both = gram.predict(df, {"y_pred": (form, gram.sums(df, [form], ["y_h1"]).total(0, "y_h1").solve(form, lam))}).join(piped, ["t", "site_number"])
    assert both.count() == df.count() and both.agg(F.max(F.abs(F.col("y_pred") - F.col("other")))).first()[0] < 1e-3


def numpy_folds(rows, n):
    order = sorted((r for r in rows if r[6] is not None), key=lambda r: (r[2], r[0], r[1]))
    size = len(order) // (n + 1)
    starts = [len(order) - (n - i) * size for i in range(n)]
    return [(order[:s], order[s : s + size]) for s in starts]


def test_a_grid_over_folds_takes_few_jobs_and_equals_numpy(spark):
    df, rows = table(spark)
    draws = [{"regParam": v} for v in (0.0, 0.01, 0.1, 1.0, 10.0, 100.0)]
    expected = []
    for p in draws:
        form, errors = gram.Linear(tuple(FEATURES)), []
        for train, valid in numpy_folds(rows, 3):
            (x, y), (u, v) = local(train, "y_h1"), local(valid, "y_h1")
            w = gram.Gram(len(y), x.T @ x, x.T @ y, y @ y).solve(form, p["regParam"])
            errors.append(np.abs(u @ w - v).mean())
        expected.append(np.mean(errors))
    known = df.where("y_h1 IS NOT NULL")
    folded, sizes = sampling.row_folds(known, 3, "ts", ["country", "site_number"])
    assert [r["count"] for r in folded.groupBy("fold").count().orderBy("fold").collect()] == sizes
    folds = [(F.col("fold") <= i, F.col("fold") == i + 1, lambda g, i=i: int(g[0]) <= i) for i in range(3)]
    spark.sparkContext.setJobGroup("grid", "grid")
    got = models._gram_errors(folded, FEATURES, "y_h1", models.linear, draws, folds, ("fold",))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got, expected)
    assert jobs <= 7  # one action for the sums and one for the errors, each with a job a shuffle (that of the input too)
    best = models.search_folds(df, FEATURES, "y_h1", models.linear, {"regParam": [p["regParam"] for p in draws]}, 6, 3)
    assert best == draws[int(np.argmin(expected))]


def test_fits_side_by_side_equal_fits_in_turn(spark):
    df, _ = table(spark, 200)
    x = df.dropna(subset=FEATURES)
    cached = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    grid, before = {"numTrees": [2, 4], "maxDepth": [2, 5]}, cached()
    a, b = (models.search_folds(x, FEATURES, "y_h1", models.forest, grid, 4, 2, workers=w) for w in (1, 4))
    assert a == b and cached() == before
    with pytest.raises(Exception, match="numTrees"):
        models.search_folds(x, FEATURES, "y_h1", models.forest, {"numTrees": [0]}, 1, 2)
    assert cached() == before


def test_each_country_is_left_out_of_its_own_model(spark):
    df, rows = table(spark)
    split = models.Split("2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-09 00:00:00")
    got = models.leave_each_country_out(df.drop("y_h1", "y_h3").withColumn("pm25", F.col("a") * 2 + F.col("b")), FEATURES, "pm25", [3], models.linear, split)
    one = models.evaluate(df.drop("y_h1", "y_h3").withColumn("pm25", F.col("a") * 2 + F.col("b")), FEATURES, "pm25", [3], models.linear, models.replace(split, exclude_country="BE")).where("country = 'BE'")
    both = got.where("country = 'BE'").join(one.withColumnRenamed("y_pred", "other"), ["country", "site_number", "ts", "horizon"])
    assert both.count() == one.count() > 0 and both.where(F.abs(F.col("y_pred") - F.col("other")) > 1e-9).count() == 0
    assert {r[0] for r in got.select("country").distinct().collect()} == {"AT", "BE", "FR"}


# --- rows by rank --------------------------------------------------------------------------------


def series(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = sorted({(rng.choice("ABC"), f"s{rng.randrange(40)}", rng.randrange(200)) for _ in range(n)})
    return spark.createDataFrame(rows, "country string, site_number string, h long").selectExpr("*", "timestamp_seconds(1704067200 + h * 3600) AS ts").repartition(6), rows


@pytest.mark.parametrize("n", [1, 7, 300, 1234, 10_000])
def test_last_rows_are_exact_at_ties(spark, n):
    df, rows = series(spark)
    expected = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:n]
    got = sampling.last_rows(df, n, "ts", ["country", "site_number"])
    assert sorted((r["country"], r["site_number"], r["h"]) for r in got.collect()) == sorted(expected)


def test_last_rows_do_not_meet_in_one_partition(spark):
    df, _ = series(spark)
    plan = sampling.last_rows(df, 500, "ts", ["country", "site_number"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Sort" not in plan and "Limit" not in plan and "TakeOrdered" not in plan


def test_last_rows_with_repeats_and_missing_times(spark):
    df = spark.createDataFrame([("A", "x", 5), ("A", "x", 5), ("A", "x", 5), ("A", "y", 7), ("B", None, 9), ("A", "z", None)], "country string, site_number string, h long").selectExpr("*", "timestamp_seconds(h * 3600) AS ts")
    take = lambda n: sorted((r["country"], r["site_number"] or "", r["h"] or -1) for r in sampling.last_rows(df, n, "ts", ["country", "site_number"]).collect())
    assert take(1) == [("A", "y", 7)] and take(3) == [("A", "x", 5), ("A", "x", 5), ("A", "y", 7)] and len(take(5)) == 5 and len(take(9)) == 6 and take(0) == []
    assert sampling.last_rows(df.where("false"), 3, "ts", ["country", "site_number"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 500, 501])
def test_seeded_samples_equal_a_sort_of_all_hashes(spark, n):
    import hashlib

    expected = sorted(range(500), key=lambda i: (hashlib.md5(f"{i}|42".encode()).hexdigest(), i))[:n]
    assert sorted(r[0] for r in sampling.seeded_sample(spark.range(500), n, ["id"]).collect()) == sorted(expected)


def test_every_registered_search_uses_the_whole_grid():
    import inspect

    text = inspect.getsource(queries)
    assert '"lam": [0.6, 1.0, 10.0], "n_splines": [10, 25]}, 6' in text
