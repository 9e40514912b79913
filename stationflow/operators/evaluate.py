"""Forecast evaluation: metrics, skill, comparison of models and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import student_p, winner
from .lagged import MOST_LAGS, lagged_products, pair_products
from .timeseries import gaps

MODELS = ("persistence", "linear", "gam", "forest", "xgb", "lgb")


def short_label(label: Column) -> Column:
    """A model's label in a narrow table: LSTM-x is L-x, Persistence is Pers."""
    return F.when(label.contains("LSTM"), F.replace(label, F.lit("LSTM-"), F.lit("L-"))).when(label == "Persistence", "Pers").otherwise(label)


def _measures() -> list[Column]:
    e = F.col("y_pred") - F.col("y_true")
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop("y_true") * F.count("y_true"), F.lit(0.0))).alias("r2"), F.avg(e).alias("bias"), F.count("*").alias("n"),
    ]


def error_metrics(predictions: DataFrame, area: str = "area") -> DataFrame:
    """scope, grp, horizon, mae, rmse, r2, bias and n, globally and by country and area, in one aggregation.

    R2 is NULL where the truth is constant; bias is prediction minus truth.
    """
    found = predictions.groupingSets([["horizon"], ["horizon", "country"], ["horizon", area]], "horizon", "country", area).agg(F.grouping_id().alias("_g"), *_measures())
    scope = F.when(F.col("_g") == 3, "Global").when(F.col("_g") == 1, "Country").otherwise("StationArea")
    return found.select(scope.alias("scope"), F.when(F.col("_g") == 3, "All").when(F.col("_g") == 1, F.col("country")).otherwise(F.col(area)).alias("grp"), "horizon", "mae", "rmse", "r2", "bias", "n")


def running_sums(predictions: DataFrame, keys: list[str], persistence: bool = False) -> DataFrame:
    """Mergeable sums per key: count, errors and truths (and the persistence forecast's errors)."""
    e, y = F.col("y_pred") - F.col("y_true"), F.col("y_true")
    sums = [F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs_sum"), F.sum(e * e).alias("sq_sum"), F.sum(e).alias("err_sum"), F.sum(y).alias("y_sum"), F.sum(y * y).alias("y2_sum")]
    if persistence:
        p = F.col("y_persistence") - y
        sums += [F.sum(F.abs(p)).alias("p_abs_sum"), F.sum(p * p).alias("p_sq_sum")]
    return predictions.groupBy(*keys).agg(*sums)


def merge_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in keys])


def metrics_of_sums(sums: DataFrame) -> DataFrame:
    """Metrics from running sums, and the ratio skill against persistence where its sums are there."""
    n = F.col("n")
    spread = F.col("y2_sum") - F.col("y_sum") * F.col("y_sum") / n
    new = {"mae": F.col("abs_sum") / n, "rmse": F.sqrt(F.col("sq_sum") / n), "r2": F.when(spread > 1e-9, 1 - F.col("sq_sum") / spread), "bias": F.col("err_sum") / n}
    if "p_abs_sum" in sums.columns:
        new["mae_persistence"] = F.col("p_abs_sum") / n
        new["rmse_persistence"] = F.sqrt(F.col("p_sq_sum") / n)
        new["skill_vs_persistence_mae"] = (F.col("p_abs_sum") - F.col("abs_sum")) / F.nullif(F.col("p_abs_sum"), F.lit(0.0))
    return sums.withColumns(new)


def coverage(df: DataFrame, train: tuple[str, str], test: tuple[str, str], keys=("country", "site_number"), ts: str = "ts", fixed_window: bool = False) -> DataFrame:
    """Start, end, observed and expected hours, completeness and longest gap of each station in both periods."""
    inside = {name: F.col(ts).between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) for name, (a, b) in (("train", train), ("test", test))}
    period = F.when(inside["train"], "train").when(inside["test"], "test")
    rows = gaps(df.select(*keys, ts, F.coalesce(period, F.lit("neither")).alias("_period")), (*keys, "_period"), ts)
    aggregates: list[Column] = []
    for name, (a, b) in (("train", train), ("test", test)):
        here = F.col("_period") == name
        own = F.when(here, F.col(ts))
        if fixed_window:
            expected = F.lit((F.unix_timestamp(F.lit(b).cast("timestamp")) - F.unix_timestamp(F.lit(a).cast("timestamp"))) / 3600).cast("long") + 1
        else:
            expected = F.coalesce(F.floor((F.unix_timestamp(F.max(own)) - F.unix_timestamp(F.min(own))) / 3600) + 1, F.lit(0))
        observed = F.countDistinct(own)
        aggregates += [F.min(own).alias(f"{name}_start"), F.max(own).alias(f"{name}_end"), observed.alias(f"{name}_observed_hours"), expected.cast("long").alias(f"{name}_expected_hours")]
        aggregates += [F.when(observed > 0, observed / expected).alias(f"{name}_completeness"), F.max(F.when(here, F.col("gap_hours"))).alias(f"{name}_max_gap_hours")]
    return rows.groupBy(*keys).agg(*aggregates)


def count_consistency(metrics: DataFrame) -> DataFrame:
    """(scope, grp, horizon) whose models do not all have the same count, with the counts."""
    found = metrics.groupBy("scope", "grp", "horizon").agg(F.countDistinct("n").alias("n_counts"), F.sort_array(F.collect_list(F.struct("model", "n"))).alias("counts"))
    return found.where("n_counts > 1")


def best_models(metrics: DataFrame, scope: str, order: tuple[str, ...] = MODELS) -> DataFrame:
    """The model with the smallest RMSE per group and horizon; the first listed wins a tie."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("model")), F.lit(len(order) + 1))
    return metrics.where(F.col("scope") == scope).groupBy("grp", "horizon").agg(F.min_by("model", F.struct("rmse", rank)).alias("best"), F.min("rmse").alias("best_rmse"))


def best_table(metrics: DataFrame, scope: str, horizons: list[int], order: tuple[str, ...] = MODELS) -> DataFrame:
    return best_models(metrics, scope, order).groupBy("grp").pivot("horizon", horizons).agg(F.first("best"))


def best_n(metrics: DataFrame, n: int) -> DataFrame:
    """The n best global models of each horizon."""
    w = Window.partitionBy("horizon").orderBy("rmse", "model")
    return metrics.where("scope = 'Global'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def loss_differential(pairs: DataFrame, loss: str = "squared") -> DataFrame:
    e1, e2 = F.col("y_true") - F.col("y_pred_1"), F.col("y_true") - F.col("y_pred_2")
    return pairs.withColumn("d", e1 * e1 - e2 * e2 if loss == "squared" else F.abs(e1) - F.abs(e2))


def autocovariances(values: DataFrame, order: list[str], lags: list[int], by: str = "horizon", value: str = "d") -> DataFrame:
    """autocovariance_k of a group's values in order; lag k divides by n - k."""
    p = lagged_products(values, order, by, value)
    return p.select(by, *[(F.col(f"p{k}") / F.nullif(F.greatest(F.col("n") - k, F.lit(0)), F.lit(0))).alias(f"autocovariance_{k}") for k in lags])


def diebold_mariano(pairs: DataFrame, order: list[str], loss: str = "squared", by: str = "horizon") -> DataFrame:
    """Statistic, its long-run variance and both RMSEs per ``by``; ``order`` (series keys, then time) is total within it.

    Negative: the first model has the smaller loss. Any number of pairs: see ``lagged_products``.
    """
    d = loss_differential(pairs, loss)
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("y_true") - F.col(c), 2)))
    errors = d.groupBy(by).agg(rmse("y_pred_1").alias("rmse_1"), rmse("y_pred_2").alias("rmse_2"))
    return _statistics(lagged_products(d, order, by), [by]).join(errors, by)


def _statistics(products: DataFrame, keys: list[str]) -> DataFrame:
    """n_samples, mean_d, hac_variance and dm_stat from lagged products."""
    n = F.col("n")
    lags = F.least(F.lit(MOST_LAGS), F.floor(F.pow(n, F.lit(0.25)) + 1e-9))
    total = F.col("p0") / n
    for k in range(1, MOST_LAGS + 1):
        total = total + F.when((F.lit(k) <= lags) & (n > k), 2 * (1 - k / (lags + 1)) * F.col(f"p{k}") / (n - k)).otherwise(0.0)
    out = products.select(*keys, n.alias("n_samples"), F.col("mean").alias("mean_d"), F.greatest(total / n, F.lit(1e-10)).alias("hac_variance"))
    return out.withColumn("dm_stat", F.when(F.col("n_samples") >= 2, F.col("mean_d") / F.sqrt("hac_variance")))


def model_losses(predictions: DataFrame, models: list[str], keys: list[str], loss: str = "squared") -> DataFrame:
    """keys and the loss of every model in a column of its name, of the rows that all of them have scored."""
    e = F.col("y_true") - F.col("y_pred")
    wide = predictions.withColumn("_loss", e * e if loss == "squared" else F.abs(e)).groupBy(*keys).pivot("model", models).agg(F.first("_loss"))
    return wide.dropna(subset=models)


def diebold_mariano_all(predictions: DataFrame, models: list[str], order: list[str], loss: str = "squared", by: str = "horizon") -> DataFrame:
    """The test of every pair of models (by, model1, model2, n_samples, mean_d, hac_variance, dm_stat, rmse_1, rmse_2) on the rows that all models have scored.

    One pass over the losses serves all pairs, so the cost is that of the samples and not of the pairs.
    """
    losses = model_losses(predictions, models, [by, *order], loss)
    squares = losses if loss == "squared" else model_losses(predictions, models, [by, *order])
    rmse = squares.groupBy(by).agg(*[F.sqrt(F.avg(m)).alias(m) for m in models]).unpivot([by], models, "model", "rmse")
    found = _statistics(pair_products(losses, order, models, by), [by, "model1", "model2"])
    for k in (1, 2):
        found = found.join(rmse.select(by, F.col("model").alias(f"model{k}"), F.col("rmse").alias(f"rmse_{k}")), [by, f"model{k}"])
    return found.select(by, "model1", "model2", "n_samples", "mean_d", "hac_variance", "dm_stat", "rmse_1", "rmse_2")


def p_value(statistic: Column, n_samples: Column) -> Column:
    """Two-sided, by Student's t with n - 1 degrees of freedom; NULL without a statistic."""

    @F.pandas_udf("double")
    def each(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 1) if pd.notna(a) and b > 1 else None for a, b in zip(t, n, strict=True)], dtype="float64")

    return each(statistic.cast("double"), n_samples.cast("double"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """p_value and winner of each test added, whatever the tests are of."""
    return tests.withColumn("p_value", p_value(F.col("dm_stat"), F.col("n_samples"))).withColumn("winner", winner(F.col("p_value"), F.col("dm_stat")))


def canonical_order(tests: DataFrame, order: tuple[str, ...] = MODELS) -> DataFrame:
    """The earlier listed model first; names, RMSEs and the statistic's sign swap together."""
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)), F.lit(len(order) + 1))
    swap = place("model1") > place("model2")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return tests.withColumns({"model1": pick("model1", "model2"), "model2": pick("model2", "model1"), "rmse_1": pick("rmse_1", "rmse_2"), "rmse_2": pick("rmse_2", "rmse_1"), "dm_stat": F.when(swap, -F.col("dm_stat")).otherwise(F.col("dm_stat"))})


def importance(attributions: DataFrame) -> DataFrame:
    """Mean and population deviation of absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance_mean"), F.stddev_pop(F.abs("value")).alias("importance_std"))


#: Attributions that one task sums by row and group.
ROWS_A_TASK = 1_500_000


def by_row(attributions: DataFrame, rows: int) -> DataFrame:
    """(row_id, feature_group, v): absolute attributions summed, of ``rows`` in all.

    Row ids are as many as rows, so partial sums would save nothing and hold a task's whole input: rows are dealt first, to tasks that grow in number with them.
    """
    n = max(attributions.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    dealt = attributions.select("row_id", "feature_group", F.abs("value").alias("v")).repartition(n, "row_id")
    return dealt.groupBy("row_id", "feature_group").agg(F.sum("v").alias("v"))


def grouped_importance(attributions: DataFrame) -> DataFrame:
    """Absolute attributions summed per row and group, then mean and deviation over rows, with the feature count. Features are few."""
    listed = attributions.groupBy("feature_group", "feature").count().collect()
    features: dict[str, int] = {}
    for r in listed:
        if r["feature_group"] is not None:
            features[r["feature_group"]] = features.get(r["feature_group"], 0) + (r["feature"] is not None)
    n = attributions.sparkSession.createDataFrame(list(features.items()), "feature_group string, n_features bigint")
    per_row = by_row(attributions, sum(r["count"] for r in listed))
    return per_row.groupBy("feature_group").agg(F.avg("v").alias("importance_mean"), F.stddev_pop("v").alias("importance_std")).join(F.broadcast(n), "feature_group")


def category_counts(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts of a fixed list of categories, 0 where none."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return wanted.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def station_directory(df: DataFrame) -> DataFrame:
    """One row per station with its label, and the centroid of its country's stations."""
    stations = df.groupBy("country", "site_number", "area").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    w = Window.partitionBy("country")
    return stations.withColumns({"centroid_latitude": F.avg("latitude").over(w), "centroid_longitude": F.avg("longitude").over(w)})


def performance_report(metrics: DataFrame, horizons: list[int]) -> DataFrame:
    """model x measure rows with a column per horizon, and the best RMSE flagged; a count row closes it."""
    best = F.min("rmse").over(Window.partitionBy("horizon"))
    g = metrics.where("scope = 'Global'").withColumn("is_best", (F.col("rmse") == best).cast("double"))
    long = g.unpivot(["model", "horizon"], ["mae", "rmse", "r2", "bias", "is_best"], "measure", "v")
    count = g.groupBy("horizon").agg(F.max("n").cast("double").alias("v")).select(F.lit("all").alias("model"), "horizon", F.lit("count").alias("measure"), "v")
    return long.unionByName(count).groupBy("model", "measure").pivot("horizon", horizons).agg(F.first("v"))


def curves(metrics: DataFrame) -> DataFrame:
    """Global measures by model and horizon, long."""
    return metrics.where("scope = 'Global'").unpivot(["model", "horizon"], ["mae", "rmse", "bias"], "measure", "v")
