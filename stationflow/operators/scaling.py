"""Station scalers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(features: list[str]) -> list:
    return [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]


def _entry(feature: str, mean, std):
    return F.struct(F.lit(feature).alias("feature"), mean.alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def station_scalers(train: DataFrame, features: list[str], keys: list[str], static: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, mean, std) of training rows; a deviation under 1e-6 is 1; static features use all stations.

    One aggregation with two columns a feature; only its result, a row per station, is made long.
    """
    moving = [c for c in features if c not in static]
    found = train.groupBy(*keys).agg(*_moments(moving)) if moving else train.select(*keys).distinct()
    entries = [_entry(c, F.col(f"{c}_m"), F.col(f"{c}_s")) for c in moving]
    if static:
        whole = train.agg(*_moments(list(static))).first()  # two values a feature of a declared list
        entries += [_entry(c, F.lit(whole[f"{c}_m"]).cast("double"), F.lit(whole[f"{c}_s"]).cast("double")) for c in static]
    return found.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.feature", "x.mean", "x.std")


def with_fallback(scalers: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The other scalers for stations that have none."""
    return scalers.unionByName(other.join(scalers.select(*keys).distinct(), keys, "left_anti"))


def stations_without(df: DataFrame, scalers: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct().subtract(scalers.select(*keys).distinct())


def standardise(df: DataFrame, scalers: DataFrame, features: list[str], keys: list[str], inverse: bool = False) -> DataFrame:
    """z-scores (or back) of the features by station; one row of scalers per station is joined."""
    wide = scalers.groupBy(*keys).pivot("feature", features).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    joined = df.join(wide, keys)
    z = {c: F.col(c) * F.col(f"{c}_s") + F.col(f"{c}_m") if inverse else (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s") for c in features}
    return joined.withColumns(z).drop(*[f"{c}_{x}" for c in features for x in "ms"])
