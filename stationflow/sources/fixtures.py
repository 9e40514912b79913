"""The driver tables seen as hourly sensor series (long, wide, weather and stations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import pivot_pollutants

COUNTRIES = ("AT", "BE", "ES", "FI", "FR")
TRAIN, TEST = ("2024-01-01 00:00:00", "2024-01-20 23:00:00"), ("2024-01-21 00:00:00", "2024-01-30 23:00:00")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Users that report to one site: many make dense series, fewer gappy ones. The number of sites grows with the users.
USERS, DENSE = 40, 100


def long(spark: SparkSession, sf_dir: str, users: int = USERS) -> DataFrame:
    """country, site_number, ts (hour), pollutant, value and k of the props; a site per ``users`` users."""
    e = table(spark, sf_dir, "events")
    site = F.floor(F.col("user_id") / users)
    return e.select(
        F.get(F.array(*map(F.lit, COUNTRIES)), (site % len(COUNTRIES)).cast("int")).alias("country"), site.cast("string").alias("site_number"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_type") == "view", "no2").when(F.col("event_type") == "purchase", "pm10").otherwise("pm25").alias("pollutant"), "value", "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("props_k"), "event_id", "user_id",
    )


def wide(spark: SparkSession, sf_dir: str, users: int = USERS) -> DataFrame:
    return pivot_pollutants(long(spark, sf_dir, users), ["country", "site_number", "ts"])


def _wind() -> dict[str, Column]:
    return {"wind_speed": F.avg(F.when(F.col("event_type") == "error", F.col("value"))), "wind_direction": 3.6 * F.avg("props_k")}


def weather(spark: SparkSession, sf_dir: str, users: int = USERS) -> DataFrame:
    """Per site and hour: wind speed and direction."""
    return long(spark, sf_dir, users).groupBy("country", "site_number", "ts").agg(*[c.alias(n) for n, c in _wind().items()])


def hourly(spark: SparkSession, sf_dir: str, users: int = USERS) -> DataFrame:
    """The rows of ``wide`` with their weather, from one scan and one aggregation."""
    return pivot_pollutants(long(spark, sf_dir, users), ["country", "site_number", "ts"], more=_wind())


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_number, area (its nation's region), made-up coordinates and name: the suppliers seen as sites."""
    p, n, r = (table(spark, sf_dir, name) for name in ("supplier", "nation", "region"))
    joined = p.join(n, p["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").cast("string").alias("site_number"), F.col("r_name").alias("area"), (40 + F.col("s_suppkey") % 101 / 7).alias("latitude"), (5 + F.col("s_suppkey") / 11).alias("longitude"), F.col("n_name").alias("station_name"))
