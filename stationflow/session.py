"""A session for series work: UTC, adaptive execution, partitions by cores."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stationflow", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return (b.master(master) if master else b).getOrCreate()
