"""Joins of the data model. Small dimensions are left to Spark's size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import AT_METADATA, first_group


def keep_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows whose (country, site_number) is listed; unparsed sites (NULL) match unparsed ones of their country."""
    s = sites.select(F.col("country").alias("_c"), F.col("site_number").alias("_s")).distinct()
    return df.join(s, (df["country"] == s["_c"]) & df["site_number"].eqNullSafe(s["_s"]), "left_semi")


def attach_metadata(df: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that are unique in the metadata."""
    return df.join(metadata, keys, "left")


def last_wins(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(code, value) with the value of the last row of each code in file order."""
    return df.select(key.alias("code"), F.col(value).alias("v"), F.col(order).alias("o")).where("code IS NOT NULL").groupBy("code").agg(F.max_by("v", "o").alias(value))


def at_lookup(metadata: DataFrame, order: str) -> DataFrame:
    return last_wins(metadata.where("country = 'AT'"), first_group(F.col("sampling_point_id"), AT_METADATA), "eoi", order)


def es_lookup(metadata: DataFrame, order: str) -> DataFrame:
    return last_wins(metadata.where("country = 'ES'"), F.col("nat_code").cast("string"), "eoi", order)


def match_by_code(points: DataFrame, found: DataFrame, code: str) -> DataFrame:
    """``eoi`` through a lookup table of codes."""
    return points.join(found.withColumnRenamed("code", code), code, "left")


def attach_coordinates(df: DataFrame, sites: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """The sites' coordinates, rounded, on every row; rows of unknown sites have none."""
    places = sites.select(*keys, *[F.round(c, digits).alias(c) for c in ("latitude", "longitude")])
    return attach_metadata(df, places, keys)


def join_anchors(samples: DataFrame, anchors: DataFrame, horizon: int, keys=("country", "site_number", "ts")) -> DataFrame:
    """The samples that can anchor a sequence for the horizon; none if there is no anchor."""
    return semi(samples, anchors.where(F.col("horizon") == horizon), list(keys))


def look_up_samples(predictions: DataFrame, table: DataFrame, columns: list[str], keys=("country", "site_number", "ts")) -> DataFrame:
    """Predictions with columns of the row that they were made at; predictions without such a row go."""
    return predictions.join(table.select(*keys, *columns), list(keys))


def attach_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on coordinates to four decimals, as integers, and the hour."""
    place = lambda c: F.round(F.col(c) * 10_000).cast("long")
    right = weather.withColumns({"_la": place("latitude"), "_lo": place("longitude")}).drop("latitude", "longitude")
    left = df.withColumns({"_la": place("latitude"), "_lo": place("longitude")})
    return left.join(right, ["_la", "_lo", "ts"], "left").drop("_la", "_lo")


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def pair_predictions(a: DataFrame, b: DataFrame, keys=("country", "site_number", "ts", "horizon")) -> DataFrame:
    """Both models' rows side by side: y_true of the first, y_pred_1 and y_pred_2."""
    left = a.select(*keys, "y_true", F.col("y_pred").alias("y_pred_1"))
    return left.join(b.select(*keys, F.col("y_pred").alias("y_pred_2")), list(keys))


def skill_against(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Left join to the baseline's metrics on (scope, grp, horizon); differences, negative is better."""
    keys = ["scope", "grp", "horizon"]
    base = baseline.select(*keys, F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
    return metrics.join(base, keys, "left").withColumns({"mae_skill": F.col("mae") - F.col("_mae"), "rmse_skill": F.col("rmse") - F.col("_rmse")}).drop("_mae", "_rmse")


def unmatched(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    keys = ["scope", "grp", "horizon"]
    return metrics.join(baseline.select(*keys), keys, "left_anti")


def group_features(importances: DataFrame, groups: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """The feature's listed group, else the first fitting prefix's, else Other. The list is short and is broadcast: dealt by feature, all rows would meet in a few tasks."""
    fallback = F.lit("Other")
    for prefix, name in reversed(list(prefixes.items())):
        fallback = F.when(F.contains(F.col("feature"), F.lit(prefix)), name).otherwise(fallback)
    return importances.join(F.broadcast(groups), "feature", "left").withColumn("feature_group", F.coalesce("feature_group", fallback))


def stations_in_both(df: DataFrame, is_train: Column, is_test: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(is_train).alias("a"), F.max(is_test).alias("b")).where("a AND b").select(*keys)


def union_all(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to combine")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
