"""Registry of the library's queries and their DuckDB forms, and the shared SQL of the fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import USERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: times as epoch seconds, doubles to six digits, counts as long."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_timestamp(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema])


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long_sql(users: int = USERS) -> str:
    return f"""long AS (SELECT list_extract(['AT','BE','ES','FI','FR'], (user_id // {users} % 5 + 1)::INT) AS country, (user_id // {users})::VARCHAR AS site_number,
  date_trunc('hour', ts) AS ts, CASE event_type WHEN 'view' THEN 'no2' WHEN 'purchase' THEN 'pm10' ELSE 'pm25' END AS pollutant,
  value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS props_k, event_id, user_id FROM events)"""


def wide_sql(users: int = USERS) -> str:
    return f"""{long_sql(users)}, wide AS (SELECT country, site_number, ts, avg(value) FILTER (pollutant = 'pm25') AS pm25, avg(value) FILTER (pollutant = 'no2') AS no2,
  avg(value) FILTER (pollutant = 'pm10') AS pm10 FROM long GROUP BY 1, 2, 3)"""


#: The sites with their areas and coordinates.
STATIONS_SQL = """(SELECT s_suppkey::VARCHAR AS site_number, r_name AS area, 40 + s_suppkey % 101 / 7 AS latitude, 5 + s_suppkey / 11 AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
STATION = "PARTITION BY country, site_number ORDER BY ts"


def back(hours: int) -> str:
    return f"({STATION} RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND INTERVAL {hours} HOUR PRECEDING)"


def ahead(hours: int) -> str:
    return f"({STATION} RANGE BETWEEN INTERVAL {hours} HOUR FOLLOWING AND INTERVAL {hours} HOUR FOLLOWING)"


def last(hours: int) -> str:
    return f"({STATION} RANGE BETWEEN INTERVAL {hours - 1} HOUR PRECEDING AND CURRENT ROW)"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


KEYS = "country, site_number, epoch(ts)::BIGINT AS ts"
