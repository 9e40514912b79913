import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.operators import evaluate, joins, sampling, scaling
from stationflow.plans import models, queries

SF = "/root/testdata/sf0.01"


def predictions(spark, rows):
    df = spark.createDataFrame([(c, str(i), "urban", i, 1, float(y), float(p)) for i, (c, y, p) in enumerate(rows)], "country string, site_number string, area string, t long, horizon int, y_true double, y_pred double")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def test_metrics_of_perfect_constant_and_empty(spark):
    m = {r["grp"]: r for r in evaluate.error_metrics(predictions(spark, [("AT", 1, 1), ("AT", 2, 2), ("BE", 3, 4), ("BE", 3, 2)])).collect()}
    assert m["AT"]["rmse"] == 0 and m["AT"]["r2"] == 1 and m["BE"]["r2"] is None and m["BE"]["bias"] == 0 and m["All"]["n"] == 4
    assert evaluate.error_metrics(predictions(spark, []).where("false")).count() == 0


def numpy_dm(d):
    n = len(d)
    lags, c = min(10, int(np.floor(n**0.25))), d - d.mean()
    v = (c * c).mean() + sum(2 * (1 - k / (lags + 1)) * (c[k:] * c[:-k]).mean() for k in range(1, lags + 1) if k < n)
    return d.mean() / math.sqrt(max(v / n, 1e-10))


def test_diebold_mariano_against_numpy_and_its_sign(spark):
    rng = np.random.default_rng(3)
    y, a, b = rng.normal(size=(3, 300))
    one, two = (predictions(spark, [("AT", u, u + 0.3 * w) for u, w in zip(y, x, strict=True)]) for x in (a, 1.4 * b))
    pairs = joins.pair_predictions(one, two)
    got = evaluate.with_p_values(evaluate.diebold_mariano(pairs, ["ts"])).first()
    back = evaluate.diebold_mariano(joins.pair_predictions(two, one), ["ts"]).first()
    assert math.isclose(got["dm_stat"], numpy_dm((0.3 * a) ** 2 - (0.42 * b) ** 2), rel_tol=1e-9) and math.isclose(got["dm_stat"], -back["dm_stat"], rel_tol=1e-9)
    assert got["winner"] == ("model1" if got["p_value"] < 0.05 and got["dm_stat"] < 0 else "tie" if got["p_value"] >= 0.05 else "model2")
    same = evaluate.diebold_mariano(joins.pair_predictions(one, one), ["ts"]).first()
    assert same["dm_stat"] == 0 and same["hac_variance"] == 1e-10
    alone = evaluate.diebold_mariano(joins.pair_predictions(one.limit(1), one), ["ts"]).first()
    assert alone["dm_stat"] is None


def test_skill_of_the_baseline_is_zero(spark):
    m = evaluate.error_metrics(predictions(spark, [("AT", 1, 2), ("BE", 2, 2)]))
    assert all(r["mae_skill"] == 0 and r["rmse_skill"] == 0 for r in joins.skill_against(m, m).collect())
    assert joins.unmatched(m, m.where("scope = 'Global'")).count() == m.count() - 1


def test_scaler_floor_and_inverse(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 2.0, 5.0)], "s string, x double, y double")
    sc = scaling.station_scalers(df, ["x", "y"], ["s"])
    assert {(r["s"], r["feature"]): r["std"] for r in sc.collect()} == {("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "x"): 1.0, ("b", "y"): 1.0}
    z = scaling.standardise(df, sc, ["x"], ["s"])
    back = scaling.standardise(z, sc, ["x"], ["s"], inverse=True)
    assert sorted(r["x"] for r in back.collect()) == [1.0, 2.0, 3.0]


def test_seeded_sample_is_exact_and_repeatable(spark):
    df = spark.range(500)
    a, b = (sorted(r[0] for r in sampling.seeded_sample(df.repartition(k), 50, ["id"]).collect()) for k in (1, 7))
    assert a == b and len(a) == 50


def test_diebold_mariano_of_many_short_series(spark):
    rng = np.random.default_rng(5)
    sizes = [1, 3, 0, 12, 1, 1, 40, 2, 25, 1]
    rows = [(h, f"s{i:02}", k, float(rng.normal())) for h in (1, 6) for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "horizon int, site string, t long, d double").repartition(5)
    got = {r["horizon"]: r for r in evaluate.lagged_products(df, ["site", "t"]).collect()}
    for h in (1, 6):
        d = np.array([r[3] for r in rows if r[0] == h])
        c = d - d.mean()
        assert got[h]["n"] == len(d) and all(math.isclose(got[h][f"p{k}"], (c[k:] * c[: len(c) - k]).sum(), abs_tol=1e-9) for k in range(11))
    one = spark.createDataFrame([(1, "a", 0, 2.0)], "horizon int, site string, t long, d double")
    assert evaluate.autocovariances(one, ["site", "t"], [1, 2]).first()["autocovariance_1"] is None
    plan = evaluate.lagged_products(df, ["site", "t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "Window" not in plan and "RepartitionByExpression [horizon#" in plan


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_all_pairs_equal_single_tests(spark, loss):
    rng = np.random.default_rng(7)
    names, rows = [f"m{i}" for i in range(10)], []
    for h in (1, 3, 6, 12, 24):
        y = rng.normal(size=120)
        for i, m in enumerate(names):
            e = rng.normal(size=120) * (0.5 + 0.1 * i)
            rows += [(m, h, f"s{k % 3}", k // 3, float(y[k]), float(y[k] + e[k])) for k in range(120) if not (i == 4 and k == 7)]
    p = spark.createDataFrame(rows, "model string, horizon int, site string, t long, y_true double, y_pred double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["horizon"], r["model1"], r["model2"]): r for r in evaluate.diebold_mariano_all(p, names, ["site", "t"], loss).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 5 * 45
    table = {(m, h): {(s, t): (y, q) for mm, hh, s, t, y, q in rows if mm == m and hh == h} for m in names for h in (1, 3, 6, 12, 24)}
    for (h, a, b), r in got.items():
        keys = sorted(set.intersection(*(set(table[m, h]) for m in names)))
        e1, e2 = (np.array([table[m, h][k][0] - table[m, h][k][1] for k in keys]) for m in (a, b))
        d = e1**2 - e2**2 if loss == "squared" else np.abs(e1) - np.abs(e2)
        assert r["n_samples"] == 119 and math.isclose(r["dm_stat"], numpy_dm(d), rel_tol=1e-8) and math.isclose(r["rmse_1"], np.sqrt((e1**2).mean()), rel_tol=1e-9)
    # and the operator for one pair on the same rows
    losses = evaluate.model_losses(p, names, ["horizon", "site", "t"], loss)
    one = {r["horizon"]: r for r in evaluate.lagged_products(losses.select("horizon", "site", "t", (F.col("m2") - F.col("m7")).alias("d")), ["site", "t"]).collect()}
    assert all(math.isclose(one[h]["mean"], got[h, "m2", "m7"]["mean_d"], rel_tol=1e-9) for h in one)


def test_static_scalers_use_all_stations(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 7.0), ("b", 2.0, 9.0)], "s string, x double, y double")
    got = {(r["s"], r["feature"]): (r["mean"], r["std"]) for r in scaling.station_scalers(df, ["x", "y"], ["s"], ("y",)).collect()}
    assert got["a", "y"] == got["b", "y"] == (7.0, pytest.approx(np.std([5, 7, 9]))) and got["a", "x"] == (2.0, 1.0)
    assert "Generate" not in scaling.station_scalers(df, ["x", "y"], ["s"])._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]


@pytest.fixture(scope="module")
def rows(spark):
    return queries._feature_rows(spark, SF).cache()


@pytest.fixture(scope="module")
def ready(spark, rows):
    from stationflow.operators import clean, timeseries

    return clean.drop_incomplete(timeseries.targets(rows, "pm25", [1]), [*queries.FEATURES, "y_h1"]).cache()


def test_linear_regression_is_least_squares(spark, ready):
    train, _ = models.sides(ready, queries.SPLIT)
    local = train.select(*queries.FEATURES, "y_h1").toPandas().to_numpy(float)
    x = np.column_stack([local[:, :-1], np.ones(len(local))])
    weights = np.linalg.lstsq(x, local[:, -1], rcond=None)[0]
    got = models.train_horizons(train, queries.FEATURES, [1], models.linear)[1].stages[-1]
    assert np.allclose(x @ weights, local[:, :-1] @ got.coefficients.toArray() + got.intercept, atol=1e-6)


def test_additive_splines_are_penalised_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 5, (200, 2))
    y = np.sin(x[:, 0]) + 0.1 * x[:, 1] ** 2 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    n, lam = 9, 0.7
    model = models.additive(["a", "b"], "y", n_splines=n, lam=lam).fit(df)
    got = np.array([r["y_pred"] for r in model.transform(df).select("y_pred").collect()])

    def basis(v):  # the recursion formula
        lo, step = v.min(), (v.max() - v.min()) / (n - 3)
        knots = [lo + (i - 3) * step for i in range(n + 4)]
        v = np.minimum(v, v.max() - step * 1e-12)
        out = [((v >= knots[i]) & (v < knots[i + 1])).astype(float) for i in range(len(knots) - 1)]
        for d in range(1, 4):
            out = [(v - knots[i]) / (d * step) * out[i] + (knots[i + d + 1] - v) / (d * step) * out[i + 1] for i in range(len(out) - 1)]
        return np.column_stack(out)

    b = np.column_stack([basis(x[:, 0]), basis(x[:, 1])])
    second = np.diff(np.eye(n), 2, axis=0)
    penalty = np.sqrt(lam) * np.block([[second, np.zeros_like(second)], [np.zeros_like(second), second]])
    weights = np.linalg.lstsq(np.vstack([b, penalty]), np.append(y, np.zeros(len(penalty))), rcond=None)[0]
    assert np.allclose(got, b @ weights, atol=1e-4)
    stiff = models.additive(["a"], "y", n_splines=n, lam=1e7).fit(df)
    flat = np.array([r[0] for r in stiff.transform(df.orderBy("a")).select("y_pred").collect()])
    order = np.sort(x[:, 0])
    assert np.abs(np.polyval(np.polyfit(order, flat, 1), order) - flat).max() < 1e-2  # a large penalty leaves a line


def mae(df, label="y_true"):
    return df.agg(F.avg(F.abs(F.col("y_pred") - F.col(label)))).first()[0]


@pytest.mark.parametrize("make, more", [(models.forest, {"numTrees": 4, "maxDepth": 4}), (models.boosted, {"preset": "depth", "maxIter": 3, "maxDepth": 3}), (models.boosted, {"preset": "leaf", "maxIter": 3, "maxDepth": 4})])
def test_tree_models_learn_a_daily_course_and_repeat(spark, rows, make, more):
    course = rows.withColumn("pm25", 10 + 5 * F.col("hour_sin") + 2 * F.col("hour_cos"))
    p, again = (models.evaluate(course, queries.FEATURES, "pm25", [1], make, queries.SPLIT, **more) for _ in range(2))
    assert mae(p) < 2 < 3 < course.agg(F.avg(F.abs(F.col("pm25") - 10))).first()[0] and math.isclose(mae(p), mae(again), rel_tol=1e-6)


def test_boosting_stops_early_on_a_validation_flag(spark, ready):
    noise = ready.withColumn("held", F.pmod(F.xxhash64("ts"), F.lit(4)) == 0).withColumn("y_h1", F.when(F.col("held"), F.rand(1) * 50).otherwise(F.col("y_h1")))
    stopped = models.boosted(queries.FEATURES, "y_h1", maxIter=15, maxDepth=4, validation="held").fit(noise).stages[-1].getNumTrees
    assert stopped < models.boosted(queries.FEATURES, "y_h1", maxIter=15, maxDepth=4).fit(noise).stages[-1].getNumTrees == 15


def test_a_country_that_is_left_out_is_scored_alone(spark, rows):
    m = models.leave_country_out(rows, "BE", queries.FEATURES, "pm25", [1], models.linear, queries.SPLIT).collect()
    assert {r["grp"] for r in m if r["scope"] == "Country"} == {"BE"}
    train, _ = models.sides(rows, models.replace(queries.SPLIT, exclude_country="BE"))
    assert 0 < train.count() < models.sides(rows, queries.SPLIT)[0].count() and train.where("country = 'BE'").count() == 0


def test_residual_forecast_adds_the_value_now(spark, rows):
    names = ["pm25", "pm25_lag_1h", "no2", "hour_sin"]  # a rolling mean would be a sum of the others
    direct = models.evaluate(rows, names, "pm25", [3], models.linear, queries.SPLIT)
    change = models.residual_forecast(rows, names, "pm25", 3, models.linear, queries.SPLIT)
    both = direct.join(change.withColumnRenamed("y_pred", "other"), ["country", "site_number", "ts", "horizon"])
    assert both.count() == change.count() > 0 and both.where(F.abs(F.col("y_pred") - F.col("other")) > 1e-6).count() == 0  # a linear model with pm25 among its features cannot tell


def test_ablation_and_permutation_hurt_the_feature_that_counts(spark, ready):
    x = ready.withColumn("y_h1", 3 * F.col("pm25_lag_1h") + 0.01 * F.col("no2"))
    model = models.train_horizons(x, queries.FEATURES, [1], models.linear)[1]
    r = models.ablation(model, x, scaling.station_scalers(x, ["pm25_lag_1h"], queries.K), ["pm25_lag_1h"], "y_h1", queries.K).first()
    assert r["base_mae"] < 1e-6 < 1 < r["delta_mae"] and r["n_sequences"] == x.count()
    rise = {a["feature"]: a["rise"] for a in models.permutation_importance(model, x, ["pm25_lag_1h", "wind_u"], "y_h1", [*queries.K, "ts"]).collect()}
    assert rise["pm25_lag_1h"] > 1 and abs(rise["wind_u"]) < 1e-6


def test_models_are_saved_and_loaded(spark, ready, tmp_path):
    from stationflow.operators import clean
    from stationflow.sources import sinks

    for name, make in (("lr", models.linear), ("gam", models.additive)):
        model = models.train_horizons(clean.as_float(ready, queries.FEATURES), queries.FEATURES, [1], make, n_splines=5)[1]
        sinks.save_model(model, str(tmp_path), name, 1)
        assert math.isclose(mae(sinks.load_model(str(tmp_path), name, 1).transform(ready), "y_h1"), mae(model.transform(ready), "y_h1"), rel_tol=1e-9)


def test_holdout_search_takes_the_better_draw(spark, ready):
    x = ready.withColumn("y_h1", 3 * F.col("pm25_lag_1h"))
    best = models.search_holdout(x, queries.FEATURES, "y_h1", models.linear, {"regParam": [0.0, 1e6]}, 2, queries.SECOND.train_end, queries.TRAIN_END, 5000, 20, {"regParam": 7})
    assert best == {"regParam": 0.0}


def test_protocol_b_is_a_subset_and_models_beat_persistence(spark, rows):
    a = models.evaluate(rows, queries.FEATURES, "pm25", [1], models.linear, queries.SPLIT).cache()
    b = models.evaluate(rows, queries.FEATURES, "pm25", [1], models.linear, queries.SPLIT, "B", 24)
    keys = ["country", "site_number", "ts", "horizon"]
    assert 0 < b.count() <= a.count() and b.join(a, keys, "left_anti").count() == 0
    rmse = evaluate.error_metrics(a).where("scope = 'Global'").first()["rmse"]
    naive = evaluate.error_metrics(queries.predictions(spark, SF, "persistence").where("horizon = 1")).where("scope = 'Global'").first()["rmse"]
    assert rmse < naive


def test_linear_attributions_sum_to_prediction_minus_mean(spark, rows):
    from stationflow.operators import clean, timeseries

    x = clean.drop_incomplete(timeseries.targets(rows, "pm25", [1]), [*queries.FEATURES, "y_h1"])
    model = models.train_horizons(x, queries.FEATURES, [1], models.linear)[1]
    total = models.linear_attributions(model, x, queries.FEATURES, ["site_number", "ts"]).groupBy("row_id").agg(F.sum("value").alias("v"))
    scored = model.transform(x).select(F.concat_ws("|", "site_number", F.col("ts").cast("string")).alias("row_id"), "y_pred")
    mean = scored.agg(F.avg("y_pred")).first()[0]
    assert scored.join(total, "row_id").where(F.abs(F.col("y_pred") - mean - F.col("v")) > 1e-6).count() == 0


def test_time_folds_expand_and_draws_are_distinct(spark, rows):
    folds = models.time_folds(rows, 2)
    assert folds[0][0].count() < folds[1][0].count() and folds[0][1].agg(F.min("ts")).first()[0] >= folds[0][0].agg(F.max("ts")).first()[0]
    assert len(models.draw({"a": [1, 2, 3], "b": [1, 2]}, 4)) == 4 and len(models.draw({"a": [1, 2]}, 9)) == 2
    assert models.search_holdout(rows.withColumn("y_h1", F.col("pm25")), queries.FEATURES, "y_h1", models.linear, {"regParam": [0.0]}, 1, queries.TRAIN_END, queries.TEST_END, 100, 10_000, {"regParam": 7}) == {"regParam": 7}


def test_histogram_boosting_beats_the_first_order_learner(spark, rows):
    from stationflow.plans import boosting

    rmse = lambda p: p.agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2)))).first()[0]
    old = rmse(models.evaluate(rows, queries.FEATURES, "pm25", [1], models.boosted, queries.SPLIT, preset="depth", maxIter=6))
    new = rmse(models.evaluate(rows, queries.FEATURES, "pm25", [1], boosting.boosting, queries.SPLIT, rounds=20, max_depth=3, learning_rate=0.1, reg_lambda=5.0, min_child_rows=20))
    print(f"held-out rmse: first-order {old:.3f}, histograms {new:.3f}")
    assert new < old


def test_grouped_importance_deals_rows_to_tasks_that_grow_with_them(spark, monkeypatch):
    rows = [(i % 40, f, (i % 7 - 3.0) if f != "pm25" else None) for i in range(60) for f in ("pm25", "pm25_lag_1h", "hour_sin", "wind")] + [(None, "wind", 2.0)]
    listed = spark.createDataFrame([("hour_sin", "Temporal")], "feature string, feature_group string")
    grouped = joins.group_features(spark.createDataFrame(rows, "row_id long, feature string, value double"), listed, {"pm25": "History"})
    assert "BroadcastHashJoin" in grouped._jdf.queryExecution().executedPlan().toString()  # four features must not deal all rows to four tasks
    monkeypatch.setattr(evaluate, "ROWS_A_TASK", 10)
    assert evaluate.by_row(grouped, len(rows)).rdd.getNumPartitions() == -(-len(rows) // 10)
    sums = {}
    for i, f, v in rows:
        if v is not None:
            g = "Temporal" if f == "hour_sin" else "History" if f.startswith("pm25") else "Other"
            sums[g, i] = sums.get((g, i), 0.0) + abs(v)
    got = {r["feature_group"]: r for r in evaluate.grouped_importance(grouped).collect()}
    assert {g: r["n_features"] for g, r in got.items()} == {"Temporal": 1, "History": 2, "Other": 1}
    for g, r in got.items():
        mine = [v for (h, _), v in sums.items() if h == g]
        assert math.isclose(r["importance_mean"], np.mean(mine)) and math.isclose(r["importance_std"], np.std(mine))
    assert evaluate.grouped_importance(grouped.where("false")).count() == 0


@pytest.mark.parametrize(("name", "fits"), [("m4_boosted_trees", 2), ("m7_holdout_search", 1), ("m6_forest_search", 1)])
def test_searches_and_fits_read_rows_that_are_written_once(spark, monkeypatch, name, fits):
    made, read, whole = [], [], queries._feature_rows
    monkeypatch.setattr(queries, "_feature_rows", lambda *x: (made.append(x), whole(*x))[1])
    for search in ("search_folds", "search_holdout"):
        monkeypatch.setattr(models, search, lambda x, *more: (read.append(x.inputFiles()), {})[1])
    monkeypatch.setattr(models, "evaluate_ready", lambda x, *more, **params: (read.append(x.inputFiles()), predictions(spark, [("AT", 1, 1)]))[1])
    getattr(queries, name)(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and len(read) == max(2, fits) and read[0] == read[1] and all("scratch" in f for f in read[0]) and read[0]


def test_fits_read_rows_that_are_dealt_to_all_cores(spark):
    parts = []

    class Stop(Exception):
        pass

    class Fit:
        def fit(self, train):
            parts.append(train.rdd.getNumPartitions())
            raise Stop

    rows = spark.range(90).select(F.lit("AT").alias("country"), F.lit("1").alias("site_number"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("y_h1")).coalesce(1)
    with pytest.raises(Stop):
        models.evaluate_ready(rows, ["a"], [1], lambda *x: Fit(), models.SPLIT_1)
    with pytest.raises(Stop):
        models.search_folds(rows, ["a"], "y_h1", lambda *x, **params: Fit(), {"k": [1]}, 1, 2, workers=1)
    assert min(parts) == 2 * spark.sparkContext.defaultParallelism


def test_ready_rows_come_from_one_reading_of_the_events(spark, monkeypatch):
    from stationflow.operators import clean, timeseries
    from stationflow.plans import features
    from stationflow.sources import fixtures

    d, scans, given, long, table = "/root/testdata/sf0.001", [], [], fixtures.long, features.feature_table
    monkeypatch.setattr(fixtures, "long", lambda *x: (scans.append(x), long(*x))[1])
    monkeypatch.setattr(features, "feature_table", lambda x, *more, **params: (given.append(x.inputFiles()), table(x, *more, **params))[1])
    got = queries._ready(spark, d)
    assert len(scans) == 1 and given[0] and all("scratch" in f for f in given[0])  # gaps are filled from written hours, not from the events again
    monkeypatch.undo()
    x = features.feature_table(fixtures.wide(spark, d, 100), fixtures.weather(spark, d, 100), (1, 2, 3), (3, 6)).join(fixtures.stations(spark, d).select("site_number", "area"), "site_number")
    want = clean.drop_incomplete(timeseries.targets(x, "pm25", [1]), queries.FEATURES).select(got.columns)
    texts = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]) for r in df.collect())
    assert texts(got) == texts(want) and got.count() > 50


def test_a_holdout_search_moves_only_the_rows_it_chose(spark, monkeypatch):
    moved, dealt = [], models.dealt
    monkeypatch.setattr(models, "dealt", lambda rows, keys: (moved.append(rows.count()), dealt(rows, keys))[1])
    rows = spark.range(200).select(F.lit("AT").alias("country"), F.lit("1").alias("site_number"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.sin("id").alias("a"), F.sin("id").alias("y_h1"))
    best = models.search_holdout(rows, ["a"], "y_h1", models.linear, {"regParam": [10.0, 0.0]}, 2, "1970-01-06 03:00:00", "1970-01-09 03:00:00", 30, 10, {})
    assert moved == [60] and best == {"regParam": 0.0}


def test_forests_are_fitted_on_vectors_that_are_made_once(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from stationflow.operators import sampling

    keys, grid = ["country", "site_number"], {"numTrees": [2, 3], "maxDepth": [1, 3]}
    rows = spark.range(600).select(F.lit("AT").alias("country"), (F.col("id") % 3).cast("string").alias("site_number"), F.timestamp_seconds(F.floor(F.col("id") / 3) * 3600).alias("ts"), F.when(F.col("id") % 50 > 0, F.sin("id")).alias("a"), F.cos("id").alias("b"))
    rows = rows.withColumn("y_h1", F.coalesce("a", F.lit(0.0)) + F.col("b"))
    folds = sampling.row_folds(models.dealt(rows, [*keys, "ts"]), 2, "ts", keys)[0].cache()
    plain = [sum(models.mean_absolute_error(models.forest(["a", "b"], "y_h1", **p).fit(folds.where(F.col("fold") <= i)), folds.where(F.col("fold") == i + 1), "y_h1") for i in range(2)) / 2 for p in models.draw(grid, 4)]
    split = models.Split("1970-01-06 00:00:00", "1970-01-06 01:00:00", "1970-01-09 00:00:00")
    train, test = models.sides(rows, split)
    want = models.score_horizons(test, {1: models.forest(["a", "b"], "y_h1", numTrees=3, maxDepth=3).fit(models.dealt(train, [*keys, "ts"]).cache())}, [*keys, "ts"])

    made, errors, transform, run = [], [], VectorAssembler.transform, models.concurrently
    monkeypatch.setattr(VectorAssembler, "transform", lambda self, df, *more: (made.append(df), transform(self, df, *more))[1])
    monkeypatch.setattr(models, "concurrently", lambda *x: (errors.extend(run(*x)), errors)[1])
    best = models.search_folds(rows, ["a", "b"], "y_h1", models.forest, grid, 4, 2)
    assert len(made) == 1 and len(errors) == 8  # not once a fit and once an error
    assert [(errors[2 * k] + errors[2 * k + 1]) / 2 for k in range(4)] == pytest.approx(plain) and best == models.draw(grid, 4)[plain.index(min(plain))]
    made.clear()
    got = models.evaluate_ready(rows, ["a", "b"], [1], models.forest, split, numTrees=3, maxDepth=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 50
    assert len(made) == 2 and all("y_h1" in x.columns for x in made)  # the training rows, kept for all passes, and the test rows


def test_boosting_goes_on_past_rounds_that_gain_nothing(spark, monkeypatch, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import GBTRegressionModel

    rows = spark.range(400).select("id", F.sin("id").alias("a"), (10 * F.sin(3 * F.sin("id"))).alias("y_h1"), (F.col("id") % 4 == 0).alias("held")).cache()
    grown, planted = [], [5.0, 4.0, 4.5, 4.2, 3.0, 3.1, 3.2, 3.3, 2.0, 1.0]  # two rounds after the second do not gain, which ends nothing; three after the fifth do
    with monkeypatch.context() as m:
        m.setattr(GBTRegressionModel, "evaluateEachIteration", lambda self, held, loss: (grown.append((self.getNumTrees, held.where("id % 4 > 0").count())), planted[: self.getNumTrees])[1])
        fit = lambda **more: models.boosted(["a"], "y_h1", maxDepth=2, validation="held", patience=3, **more).fit(rows)
        whole, bounded, short = fit(), fit(maxIter=6), fit(maxIter=2)
    assert grown == [(4, 0), (8, 0), (4, 0), (6, 0), (2, 0)]
    assert [x.stages[-1].getNumTrees for x in (whole, bounded, short)] == [5, 5, 2]
    want = models.boosted(["a"], "y_h1", maxDepth=2, maxIter=5).fit(rows.where("NOT held"))
    whole.write().overwrite().save(str(tmp_path / "m"))
    got = [[r["y_pred"] for r in x.transform(rows).orderBy("id").collect()] for x in (whole, PipelineModel.load(str(tmp_path / "m")), want)]
    assert got[0] == got[1] == pytest.approx(got[2])
    learnt = models.boosted(["a"], "y_h1", maxDepth=2, validation="held", patience=5, maxIter=40).fit(rows).stages[-1]
    assert learnt.getNumTrees > 30  # each round of a plain signal gains
    for flag in ("true", "false"):
        with pytest.raises(ValueError, match="needed to stop by"):
            models.boosted(["a"], "y_h1", validation="held").fit(rows.withColumn("held", F.expr(flag)))


def test_boosted_trees_have_the_published_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "evaluate_ready", lambda x, names, h, make, split, **params: (asked.append(make(names, "y_h1", **params).getStages()[-1]), predictions(spark, [("AT", 1, 1)]))[1])
    queries.m4_boosted_trees(spark, "/root/testdata/sf0.001")
    assert [(s.model.getMaxIter(), s.patience, s.flag) for s in asked] == [(1500, 50, "held"), (20_000, 200, "held")]
    assert models.best_round([3.0, 2.0, 2.0, 2.5], 2) == (2, True) and models.best_round([3.0, 2.0, 2.0], 2) == (2, False)
