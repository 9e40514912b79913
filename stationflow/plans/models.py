"""Direct multi-horizon forecasting on MLlib: one model per horizon under strict time splits."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clean import between, drop_incomplete
from ..operators.evaluate import error_metrics
from ..operators.sampling import last_rows, row_folds
from ..operators.timeseries import STATION, anchors, targets
from . import boosting, gram


@dataclass(frozen=True)
class Split:
    """Inclusive bounds; ``train_start`` None has no lower bound."""

    train_end: str
    test_start: str
    test_end: str
    train_start: str | None = None
    exclude_country: str | None = None


# The two published splits.
SPLIT_1 = Split("2022-12-31 23:00:00", "2023-01-01 00:00:00", "2024-12-31 23:00:00")
SPLIT_2 = Split("2024-06-30 23:00:00", "2024-07-01 00:00:00", "2024-12-31 23:00:00")


def linear(features: list[str], label: str, **params) -> Pipeline:
    return _pipeline(features, LinearRegression(labelCol=label, solver="normal", regParam=params.get("regParam", 0.0)))


def forest(features: list[str], label: str, **params) -> Pipeline:
    deep = min(int(params.get("maxDepth", 10) or 30), 30)
    own = {"minInstancesPerNode": int(params.get("minInstancesPerNode", 1)), "featureSubsetStrategy": str(params.get("featureSubsetStrategy", "auto"))}
    return _pipeline(features, RandomForestRegressor(labelCol=label, numTrees=int(params.get("numTrees", 20)), maxDepth=deep, seed=42, **own))


#: Rounds where nothing stops them; with validation rows the largest published number of them, and the published number without a smaller error that ends them.
BOOSTED = {"depth": {"maxDepth": 6, "maxIter": 30, "most": 1500, "patience": 50}, "leaf": {"maxDepth": 8, "maxIter": 20, "most": 20_000, "patience": 200}}


def boosted(features: list[str], label: str, **params) -> Pipeline:
    """``preset`` depth (shallow trees) or leaf (deeper ones).

    Where ``validation`` names a flag column, its rows end the rounds (see ``Stopped``); ``maxIter`` bounds them. MLlib cuts the lineage of long fits only where a checkpoint folder is set.
    """
    preset = BOOSTED[params.get("preset", "depth")]
    rounds = int(params.get("maxIter", preset["most" if params.get("validation") else "maxIter"]))
    made = _pipeline(features, GBTRegressor(labelCol=label, seed=42, stepSize=float(params.get("stepSize", 0.1)), maxDepth=int(params.get("maxDepth", preset["maxDepth"])), maxIter=rounds))
    if not params.get("validation"):
        return made
    assembler, model = made.getStages()
    return Pipeline(stages=[assembler, Stopped(model, params["validation"], int(params.get("patience", preset["patience"])))])


class Stopped(Estimator):
    """Boosted trees up to the smallest squared error on the rows of a flag column, which are not learnt from; rounds end after ``patience`` ones without a smaller error.

    MLlib's own flag ends them at the first round that gains too little. A fit cannot go on from another, so one that was not stopped is made anew with twice
    the rounds, until the model's own ``maxIter``; what comes out does not depend on the lengths tried.
    """

    def __init__(self, model: GBTRegressor, flag: str, patience: int):
        super().__init__()
        self.model, self.flag, self.patience = model, flag, patience

    def _fit(self, rows: DataFrame) -> GBTRegressionModel:
        counts = {r[0]: r[1] for r in rows.groupBy(self.flag).count().collect()}
        if not counts.get(True) or not counts.get(False):
            raise ValueError(f"rows with and without {self.flag} are needed to stop by")
        # many short passes: few rows are not worth a task for each core
        train = rows.where(~F.col(self.flag)).coalesce(max(1, counts[False] // boosting.BLOCK))
        most = self.model.getMaxIter()
        rounds = min(most, self.patience + max(1, self.patience // 5))
        while True:
            found = self.model.copy({self.model.maxIter: rounds}).fit(train)
            best, stopped = best_round(found.evaluateEachIteration(rows.where(F.col(self.flag)), "squared"), self.patience)
            if stopped or rounds == most:
                return found if best == rounds else first_trees(found, best, rows.sparkSession)
            rounds = min(most, 2 * rounds)


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round of the smallest error before ``patience`` rounds without a smaller one, and whether there were so many."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, n: int, spark) -> GBTRegressionModel:
    """The model of the first n trees; MLlib has its public constructor in the JVM only."""
    sc = spark.sparkContext
    jvm = sc._jvm.org.apache.spark.ml.regression
    trees, weights = sc._gateway.new_array(jvm.DecisionTreeRegressionModel, n), sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(model.trees[:n], model.treeWeights[:n], strict=True)):
        trees[i], weights[i] = tree._java_obj, weight
    made = GBTRegressionModel(jvm.GBTRegressionModel(model.uid, trees, weights))
    return made.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


VECTOR = "features_vector"


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="skip")


def _pipeline(features: list[str], model) -> Pipeline:
    return Pipeline(stages=[_assembler(features), model.setFeaturesCol(VECTOR).setPredictionCol("y_pred")])


#: Models that read their rows many times, as vectors of the features.
VECTORS = (forest, boosted)


def vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows with the vector that a pipeline of ``VECTORS`` would make in every pass of every fit; rows that lack a feature go, as there."""
    return _assembler(features).transform(rows).drop(*features)


def fitted(made: Pipeline, rows: DataFrame) -> PipelineModel:
    """The pipeline fitted on rows, or on their vectors."""
    if VECTOR not in rows.columns:
        return made.fit(rows)
    assembler, model = made.getStages()
    return PipelineModel(stages=[assembler, model.fit(rows)])


@dataclass(frozen=True)
class Additive:
    """One smooth per feature: B-splines on equal knots, with the difference penalty ``lam`` on neighbouring coefficients.

    The penalty enters as a few more rows of the least-squares problem, one per second difference:
    sqrt(lam) x (1, -2, 1) with label 0. The fitted pipeline makes its basis itself, so it can be saved.
    """

    features: list[str]
    label: str
    n_splines: int = 20
    lam: float = 0.6
    degree: int = 3

    def _basis(self, lo: float, step: float, column: str) -> list[str]:
        """The basis as SQL: each spline is a sum of shifted truncated powers of the place on the knots."""
        d, inner = self.degree, self.n_splines - self.degree
        place = f"(least(greatest(CAST(`{column}` AS DOUBLE), {lo!r}D), {lo + inner * step!r}D) - {lo!r}D) / {step!r}D"
        terms = lambda i: " + ".join(f"{(-1) ** k * math.comb(d + 1, k) / math.factorial(d)!r}D * power(greatest({place} - {float(i - d + k)!r}D, 0D), {d})" for k in range(d + 2))
        return [terms(i) for i in range(self.n_splines)]

    def fit(self, train: DataFrame) -> PipelineModel:
        ends = train.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in self.features for n, f in (("lo", F.min), ("hi", F.max))]).first()
        columns, names = [], []
        for c in self.features:
            lo, hi = ends[f"{c}_lo"] or 0.0, ends[f"{c}_hi"] or 0.0
            step = max((hi - lo) / (self.n_splines - self.degree), 1e-9)
            for i, text in enumerate(self._basis(lo, step, c)):
                names.append(f"{c}_spline_{i}")
                columns.append(f"{text} AS `{names[-1]}`")
        known = train.dropna(subset=self.features)
        basis = SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")
        assembler = VectorAssembler(inputCols=names, outputCol="features_vector", handleInvalid="skip")
        rows = assembler.transform(basis.transform(known)).select("features_vector", F.col(self.label).cast("double").alias(self.label))
        size, root = len(names), math.sqrt(self.lam)
        penalty = [(Vectors.sparse(size, {f * self.n_splines + i + k: root * w for k, w in enumerate((1.0, -2.0, 1.0))}), 0.0) for f in range(len(self.features)) for i in range(self.n_splines - 2)]
        extra = train.sparkSession.createDataFrame(penalty, ["features_vector", self.label])
        # the splines of a feature sum to 1, so they hold the intercept; a slight ridge settles what several features share
        model = LinearRegression(labelCol=self.label, featuresCol="features_vector", predictionCol="y_pred", solver="normal", fitIntercept=False, standardization=False, regParam=1e-8).fit(rows.unionByName(extra))
        return PipelineModel(stages=[basis, assembler, model])


def additive(features: list[str], label: str, **params) -> Additive:
    return Additive(features, label, int(params.get("n_splines", 20)), float(params.get("lam", 0.6)))


def train_horizons(train: DataFrame, features: list[str], horizons: list[int], make: Callable[..., Pipeline], **params) -> dict[int, PipelineModel]:
    """One fit per horizon on the rows that have its target."""
    return {h: fitted(make(features, f"y_h{h}", **params), train.where(F.col(f"y_h{h}").isNotNull())) for h in horizons}


def score_horizons(test: DataFrame, models: dict[int, PipelineModel], keep: list[str]) -> DataFrame:
    """keep, horizon, y_true and y_pred of every model's rows with a target."""
    out = None
    for h, model in models.items():
        found = model.transform(test.where(F.col(f"y_h{h}").isNotNull())).select(*keep, F.lit(h).alias("horizon"), F.col(f"y_h{h}").alias("y_true"), "y_pred")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no model was given")
    return out


def sides(df: DataFrame, split: Split, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    train = between(df, ts, split.train_start, split.train_end)
    if split.exclude_country:
        train = train.where(F.col("country") != split.exclude_country)
    return train, between(df, ts, split.test_start, split.test_end)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt evenly to all cores: a small or aggregated table may lie in few partitions, and each step of a fit takes as long as the largest."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def evaluate(df: DataFrame, features: list[str], target: str, horizons: list[int], make: Callable[..., Pipeline], split: Split, protocol: str = "A", lookback: int = 168, keys=STATION, ts: str = "ts", **params) -> DataFrame:
    """Predictions on the test side. Protocol A uses all complete rows; B only rows that can anchor a sequence.

    Anchors are built before a country is excluded.
    """
    ready = drop_incomplete(targets(df, target, horizons, keys, ts), features)
    if protocol == "B":
        found = anchors(df, features, target, horizons, lookback, split.train_end, split.test_start, split.test_end, keys=keys, ts=ts)
        keep = found.groupBy(*keys, ts).agg(F.collect_set("horizon").alias("_h"))
        ready = ready.join(keep, [*keys, ts]).withColumns({f"y_h{h}": F.when(F.array_contains("_h", h), F.col(f"y_h{h}")) for h in horizons}).drop("_h")
    return evaluate_ready(ready, features, horizons, make, split, keys, ts, **params)


def evaluate_ready(ready: DataFrame, features: list[str], horizons: list[int], make: Callable[..., Pipeline], split: Split, keys=STATION, ts: str = "ts", **params) -> DataFrame:
    """As ``evaluate`` on complete rows that have their targets, such as a table of them that several fits read."""
    train, test = sides(ready, split, ts)
    keep = [*keys, *(c for c in ("area",) if c in ready.columns), ts]
    if make in GRAM:
        return predict_horizons(test, solve_horizons(train, features, horizons, make, **params), horizons, keep)
    train = dealt(train, [*keys, ts])
    train = (vectors(train, features) if make in VECTORS else train).cache()  # read once per horizon and iteration
    try:
        found = train_horizons(train, features, horizons, make, **params)
    finally:
        train.unpersist()
    return score_horizons(test, found, keep)


#: Models that are solved from sums (see ``gram``).
GRAM = (linear, additive)


def design(rows: DataFrame, features: list[str], make: Callable, **params) -> tuple[gram.Design, float]:
    """The design and the penalty of a model that is solved from sums; the knots of smooths come from ``rows``."""
    if make is linear:
        return gram.Linear(tuple(features)), float(params.get("regParam", 0.0))
    return gram.splines(rows, features, int(params.get("n_splines", 20))), float(params.get("lam", 0.6))


def solve_horizons(train: DataFrame, features: list[str], horizons: list[int], make: Callable, **params) -> dict[int, tuple[gram.Design, np.ndarray]]:
    """The solution of every horizon, from one pass over the training rows."""
    form, lam = design(train, features, make, **params)
    found = gram.sums(train, [form], [f"y_h{h}" for h in horizons])
    totals = {h: found.total(0, f"y_h{h}") for h in horizons}
    if missing := [h for h, t in totals.items() if t is None]:
        raise ValueError(f"no complete training rows for horizons {missing}")
    return {h: (form, t.solve(form, lam)) for h, t in totals.items()}


def predict_horizons(test: DataFrame, solved: dict[int, tuple[gram.Design, np.ndarray]], horizons: list[int], keep: list[str]) -> DataFrame:
    """As ``score_horizons``: all horizons in one pass."""
    scored = gram.predict(test.select(*keep, *[f"y_h{h}" for h in horizons], *[c for c in next(iter(solved.values()))[0].features if c not in keep]), {f"_p{h}": solved[h] for h in horizons})
    return _long(scored, {h: F.col(f"_p{h}") for h in horizons}, keep)


def _long(scored: DataFrame, predicted: dict[int, Column], keep: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_h{h}").cast("double").alias("y_true"), p.alias("y_pred")) for h, p in predicted.items()])
    return scored.select(*keep, F.explode(each).alias("t")).select(*keep, "t.*").where("y_true IS NOT NULL AND y_pred IS NOT NULL")


def leave_each_country_out(df: DataFrame, features: list[str], target: str, horizons: list[int], make: Callable, split: Split, keys=STATION, ts: str = "ts", **params) -> DataFrame:
    """Predictions of every country by the model of all others: one pass for the sums, one for all models' predictions.

    Countries are few (a code list); each model is the total less its country's sums.
    """
    ready = drop_incomplete(targets(df, target, horizons, keys, ts), features)
    train, test = sides(ready, split, ts)
    form, lam = design(train, features, make, **params)
    found = gram.sums(train, [form], [f"y_h{h}" for h in horizons], ("country",))
    countries = sorted({k[2] for k in found.found if k[2] is not None})
    solved = {}
    for h in horizons:
        whole = found.total(0, f"y_h{h}")
        for c in countries:
            own = found.found.get((0, f"y_h{h}", c))
            if whole is not None and (own is None or whole.n > own.n):
                solved[f"_p{h}_{c}"] = form, (whole - own if own else whole).solve(form, lam)
    keep = [*keys, *(c for c in ("area",) if c in df.columns), ts]
    scored = gram.predict(test.select(*keep, *[f"y_h{h}" for h in horizons], *[c for c in features if c not in keep]), solved)
    own_model = lambda h: F.coalesce(*[F.when(F.col("country") == c, F.col(f"_p{h}_{c}")) for c in countries if f"_p{h}_{c}" in solved], F.lit(None).cast("double"))
    return _long(scored, {h: own_model(h) for h in horizons}, keep)


def leave_country_out(df: DataFrame, country: str, features: list[str], target: str, horizons: list[int], make: Callable[..., Pipeline], split: Split, **more) -> DataFrame:
    """Metrics on a country that training never saw."""
    p = evaluate(df, features, target, horizons, make, replace(split, exclude_country=country), **more)
    return error_metrics(p.where(F.col("country") == country).withColumn("area", F.lit("all")))


def residual_forecast(df: DataFrame, features: list[str], target: str, horizon: int, make: Callable[..., Pipeline], split: Split, keys=STATION, ts: str = "ts", **params) -> DataFrame:
    """Predicts the change from now and adds it back."""
    x = drop_incomplete(targets(df, target, [horizon], keys, ts), [*features, target]).withColumn("_change", F.col(f"y_h{horizon}") - F.col(target))
    train, test = sides(x, split, ts)
    model = make(features, "_change", **params).fit(train.where("_change IS NOT NULL"))
    return model.transform(test.where("_change IS NOT NULL")).select(*keys, ts, F.lit(horizon).alias("horizon"), F.col(f"y_h{horizon}").alias("y_true"), (F.col("y_pred") + F.col(target)).alias("y_pred"))


def time_folds(df: DataFrame, n: int, ts: str = "ts", keys=STATION) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding folds by global row order (time, then keys): each validates on the next of n equal parts at the end."""
    rows, _ = row_folds(df, n, ts, list(keys))
    return [(rows.where(F.col("fold") <= i).drop("fold"), rows.where(F.col("fold") == i + 1).drop("fold")) for i in range(n)]


def mean_absolute_error(model: PipelineModel, rows: DataFrame, label: str) -> float:
    model = model.stages[-1] if VECTOR in rows.columns else model
    return float(model.transform(rows).agg(F.avg(F.abs(F.col("y_pred") - F.col(label)))).first()[0] or 0.0)


def draw(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n different combinations of the grid (all, if it has fewer)."""
    every = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


#: Fits that a search runs side by side.
CONCURRENT = 4


def concurrently(spark, jobs: list[Callable[[], float]], workers: int = CONCURRENT) -> list[float]:
    """The results of the jobs in order; each runs in a scheduler pool of its own, so that with fair scheduling none waits for another's stages."""

    def one(numbered):
        i, job = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{i % workers}")
        return job()

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), enumerate(jobs)))


def search_folds(df: DataFrame, features: list[str], label: str, make: Callable[..., Pipeline], grid: dict[str, list], n_draws: int, n_folds: int, ts: str = "ts", keys=STATION, workers: int = CONCURRENT) -> dict:
    """The drawn combination with the smallest mean absolute error over expanding folds by row order.

    Models that are solved from sums need one pass for all folds and draws and one for their errors; others are
    fitted side by side on folds that are cached once, as vectors where the models read these.
    """
    draws = draw(grid, n_draws)
    known = rows = dealt(df.where(F.col(label).isNotNull()), [*keys, ts]).cache()  # ranks, fits and errors all read it
    try:
        known.count()  # before several fits ask for it at once
        rows, _ = row_folds(known, n_folds, ts, list(keys))
        if make in VECTORS:
            rows = vectors(rows, features).select(VECTOR, label, "fold").cache()
            rows.count()
            known.unpersist()
        if make in GRAM:
            errors = _gram_errors(rows, features, label, make, draws, [(F.col("fold") <= i, F.col("fold") == i + 1, lambda g, i=i: int(g[0]) <= i) for i in range(n_folds)], ("fold",))
        else:
            jobs = [lambda p=p, i=i: mean_absolute_error(fitted(make(features, label, **p), rows.where(F.col("fold") <= i)), rows.where(F.col("fold") == i + 1), label) for p in draws for i in range(n_folds)]
            each = concurrently(df.sparkSession, jobs, workers)
            errors = [sum(each[k * n_folds : (k + 1) * n_folds]) / n_folds for k in range(len(draws))]
    finally:
        rows.unpersist()
        known.unpersist()
    return draws[min(range(len(draws)), key=lambda k: (errors[k], k))]


def _gram_errors(rows: DataFrame, features: list[str], label: str, make: Callable, draws: list[dict], folds: list[tuple], groups: tuple[str, ...]) -> list[float]:
    """Mean absolute error of each draw over folds (training rows, validation rows, training groups); one pass for the sums, one for the errors."""
    ends = {}  # one design for each number of splines
    for p in draws:
        key = p.get("n_splines") if make is additive else None
        if key not in ends:
            ends[key] = design(rows.where(folds[-1][0]), features, make, **p)[0] if not ends or make is linear else replace(next(iter(ends.values())), n_splines=int(key))
    forms = list(ends.values())
    found = gram.sums(rows, forms, [label], groups)
    models, where = {}, {}
    for k, p in enumerate(draws):
        d = list(ends).index(p.get("n_splines") if make is additive else None)
        lam = float(p.get("lam", 0.6)) if make is additive else float(p.get("regParam", 0.0))
        for i, (_, valid, mine) in enumerate(folds):
            total = found.total(d, label, mine)
            if total is not None:
                models[f"_m{k}_{i}"], where[f"_m{k}_{i}"] = (forms[d], total.solve(forms[d], lam)), valid
    errors = gram.absolute_errors(rows, models, dict.fromkeys(models, label), where) if models else {}
    return [sum(errors.get(f"_m{k}_{i}", float("inf")) for i in range(len(folds))) / len(folds) for k in range(len(draws))]


def search_holdout(df: DataFrame, features: list[str], label: str, make: Callable[..., Pipeline], grid: dict[str, list], n_draws: int, train_end: str, valid_end: str, last_n: int, least: int, default: dict, ts: str = "ts", keys=STATION, workers: int = CONCURRENT) -> dict:
    """As above on the last rows before a date against the last rows after it; the default where a side is too small."""
    draws = draw(grid, n_draws)
    known = between(df.where(F.col(label).isNotNull()), ts, None, valid_end).cache()  # ranks read it
    rows = known
    try:
        late = F.col(ts) > F.lit(train_end).cast("timestamp")
        train = last_rows(known.where(~late), last_n, ts, list(keys)).withColumn("_side", F.lit(0))
        valid = last_rows(known.where(late), last_n, ts, list(keys)).withColumn("_side", F.lit(1))
        rows = dealt(train.unionByName(valid), [*keys, ts]).cache()  # only the chosen rows are moved; fits and errors read them
        counts = {r["_side"]: r["count"] for r in rows.groupBy("_side").count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) <= least:
            return default
        a, b = F.col("_side") == 0, F.col("_side") == 1
        if make in GRAM:
            errors = _gram_errors(rows, features, label, make, draws, [(a, b, lambda g: g[0] == "0")], ("_side",))
        else:
            errors = concurrently(df.sparkSession, [lambda p=p: mean_absolute_error(make(features, label, **p).fit(rows.where(a)), rows.where(b), label) for p in draws], workers)
        return draws[min(range(len(draws)), key=lambda k: (errors[k], k))]
    finally:
        rows.unpersist()
        known.unpersist()


def linear_attributions(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """coef x (x - mean) of a linear model, long; they sum to the prediction minus the mean prediction."""
    weights = model.stages[-1].coefficients.toArray().tolist()
    means = rows.agg(*[F.avg(c).alias(c) for c in features]).first()
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("value")) for c, w in zip(features, weights, strict=True)])
    return rows.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_id"), F.explode(parts).alias("x")).select("row_id", "x.feature", "x.value")


#: Rows among which a feature is shuffled.
SHUFFLED = 10_000


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """(feature, rise): of the mean absolute error when a feature is shuffled by a seeded hash.

    Rows are dealt by a hash of their keys to buckets of about ``SHUFFLED`` rows and numbered within them twice, by key and by hash; one join
    of the two gives every row the shuffled values of all features, and each row is scored once as it is and once for each feature.
    """
    here = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows.count() // SHUFFLED)))))
    numbered = lambda *order: F.row_number().over(Window.partitionBy("_b").orderBy(*order)).alias("_i")
    shuffled = here.select("_b", F.struct(*features).alias("_s"), numbered(F.xxhash64(*keys, F.lit(seed)), *keys))
    both = here.select("*", numbered(*keys)).join(shuffled, ["_b", "_i"]).select("*", F.explode(F.array(*map(F.lit, ["", *features]))).alias("_feature"))
    changed = both.withColumns({c: F.when(F.col("_feature") == c, F.col("_s")[c]).otherwise(F.col(c)) for c in features})
    found = {r["_feature"]: r["e"] for r in model.transform(changed).groupBy("_feature").agg(F.avg(F.abs(F.col("y_pred") - F.col(label))).alias("e")).collect()}
    return rows.sparkSession.createDataFrame([(c, float(found[c] - found[""])) for c in features if found], "feature string, rise double")


def ablation(model: PipelineModel, rows: DataFrame, scalers: DataFrame, hidden: list[str], label: str, keys: list[str]) -> DataFrame:
    """Errors with the hidden features at their station means against errors as they are."""
    means = scalers.groupBy(*keys).pivot("feature", hidden).agg(F.first("mean"))
    masked = rows.drop(*hidden).join(means, keys)
    e = F.abs(F.col("y_pred") - F.col(label))
    both = model.transform(rows).select(F.lit("base").alias("kind"), e.alias("e")).unionByName(model.transform(masked).select(F.lit("hidden").alias("kind"), e.alias("e")))
    one = both.agg(*[f(F.when(F.col("kind") == k, x)).alias(f"{k}_{n}") for k in ("base", "hidden") for n, f, x in (("mae", F.avg, F.col("e")), ("ms", F.avg, F.col("e") * F.col("e")))], F.count_if(F.col("kind") == "base").alias("n_sequences"))
    r = one.select("base_mae", F.sqrt("base_ms").alias("base_rmse"), "hidden_mae", F.sqrt("hidden_ms").alias("hidden_rmse"), "n_sequences")
    return r.withColumns({"delta_mae": F.col("hidden_mae") - F.col("base_mae"), "delta_rmse": F.col("hidden_rmse") - F.col("base_rmse"), "relative_degradation_pct": 100 * (F.col("hidden_rmse") - F.col("base_rmse")) / F.nullif(F.col("base_rmse"), F.lit(0.0))})
