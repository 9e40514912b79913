"""Projections, filters, pivots and reports on measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, non_negative

POLLUTANTS = ("pm25", "no2", "pm10")
# Columns of the sequence models, in order.
SEQUENCE_FEATURES = """
    latitude longitude altitude StationType_background StationType_industrial StationType_traffic StationArea_rural StationArea_rural-nearcity
    StationArea_suburban StationArea_urban temperature_2m relative_humidity_2m dew_point_2m wind_u wind_v precipitation surface_pressure pm25 no2 pm10
    hour day_of_week day_of_month month year is_weekend season hour_sin hour_cos month_sin month_cos no2_lag_12h no2_lag_168h no2_lag_1h no2_lag_24h
    no2_lag_2h no2_lag_3h no2_lag_6h pm10_lag_12h pm10_lag_168h pm10_lag_1h pm10_lag_24h pm10_lag_2h pm10_lag_3h pm10_lag_6h pm25_lag_12h
    pm25_lag_168h pm25_lag_1h pm25_lag_24h pm25_lag_2h pm25_lag_3h pm25_lag_6h no2_rolling_mean_12h no2_rolling_mean_24h no2_rolling_mean_3h
    no2_rolling_mean_6h pm10_rolling_mean_12h pm10_rolling_mean_24h pm10_rolling_mean_3h pm10_rolling_mean_6h pm25_rolling_mean_12h
    pm25_rolling_mean_24h pm25_rolling_mean_3h pm25_rolling_mean_6h no2_rolling_std_12h no2_rolling_std_24h no2_rolling_std_3h no2_rolling_std_6h
    pm10_rolling_std_12h pm10_rolling_std_24h pm10_rolling_std_3h pm10_rolling_std_6h pm25_rolling_std_12h pm25_rolling_std_24h pm25_rolling_std_3h
    pm25_rolling_std_6h
""".split()


def drop_sentinels(df: DataFrame, columns=POLLUTANTS) -> DataFrame:
    return df.withColumns({c: non_negative(F.col(c)) for c in columns})


def require_target(df: DataFrame, target: str = "pm25") -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_incomplete(df: DataFrame, columns: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Rows without a NULL in the columns, or in those whose name contains ``pattern``."""
    return df.dropna(subset=columns or [c for c in df.columns if pattern and pattern in c])


def finite_numbers(df: DataFrame) -> DataFrame:
    """Infinity and NaN to NULL in every floating column."""
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def between(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Rows within inclusive bounds; the filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col(ts) <= F.lit(end).cast("timestamp"))


def with_warmup(df: DataFrame, ts: str, start: str, end: str, hours: int = 167) -> DataFrame:
    """Rows from ``hours`` before the start on."""
    return df.where((F.col(ts) >= F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= F.lit(end).cast("timestamp")))


def select_features(df: DataFrame, exclude=("country", "site_number", "ts", "pm25", "season")) -> list[str]:
    """Numeric and boolean columns but for targets and exclusions, then the other pollutants, each once."""
    found = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude and not f.name.startswith("y_h")]
    return list(dict.fromkeys([*found, *(c for c in ("no2", "pm10") if c in df.columns)]))


def sequence_features(df: DataFrame) -> list[str]:
    """The fixed list as far as it is there; the target pollutant must be."""
    found = [c for c in SEQUENCE_FEATURES if c in df.columns]
    if "pm25" not in found:
        raise ValueError("pm25 is needed by sequence models")
    return found


def one_hour_features(df: DataFrame) -> list[str]:
    """The curated list for one-hour models: weather, calendar, lags, rolling values and one-hot metadata."""
    fixed = [c for c in SEQUENCE_FEATURES if c not in ("pm25", "season") and not c.startswith("Station")]
    return [c for c in fixed if c in df.columns] + [c for c in df.columns if c.startswith(("StationType_", "StationArea_"))]


def ordered(df: DataFrame, first: list[str], doubles=POLLUTANTS) -> DataFrame:
    """``first`` and then the other columns; absent pollutants are added as NULL."""
    df = df.withColumns({c: F.lit(None).cast("double") for c in doubles if c not in df.columns})
    return df.select(*first, *[f"`{c}`" for c in df.columns if c not in first])


def exclude(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) != value)


def exclude_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(~F.col(column).startswith(prefix))


def quality_filter(coverage: DataFrame, least: float = 0.5, longest_gap: float | None = 168) -> DataFrame:
    """Stations that are complete enough in both periods; a NULL gap fails."""
    ok = (F.col("train_completeness") >= least) & (F.col("test_completeness") >= least) & (F.col("test_observed_hours") > 0)
    return coverage.where(ok if longest_gap is None else ok & (F.col("test_max_gap_hours") <= longest_gap))


def point_lookup(metrics: DataFrame, scope: str, group: str, horizon: int) -> DataFrame:
    return metrics.where((F.col("scope") == scope) & (F.col("grp") == group) & (F.col("horizon") == horizon))


def renamed(df: DataFrame, names: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumnsRenamed(names).drop(*drop)


def as_float(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def pivot_pollutants(long: DataFrame, keys: list[str], names=POLLUTANTS, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with a mean column per pollutant; keys with NULL and rows without any value go.

    A pivot by conditional means: one exchange, where ``pivot`` would first aggregate by key and pollutant. ``more``
    are further aggregates of the same rows.
    """
    for k in keys:
        long = long.where(F.col(k).isNotNull())
    return long.groupBy(*keys).agg(*[F.avg(F.when(F.col("pollutant") == p, F.col("value"))).alias(p) for p in names], *[c.alias(n) for n, c in (more or {}).items()]).dropna(how="all", subset=list(names))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing and missing_pct, counted in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])).alias("x"))
    return long.select("x.column_name", "x.missing", (100 * F.col("x.missing") / F.nullif(F.col("n"), F.lit(0))).alias("missing_pct"))


def dataset_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), F.countDistinct("country", "site_number").alias("n_sites"),
    )


def feature_catalogue(df: DataFrame, groups: dict[str, Column | str]) -> DataFrame:
    """(feature, feature_group) of every column, by the first prefix that fits."""
    rows = [(c, next((g for g, prefix in groups.items() if c.startswith(prefix)), "other")) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "feature string, feature_group string")
