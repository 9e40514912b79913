"""The feature table as one lazy plan: clean, fill, weather, calendar, lags, rolling values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import calendar, cyclic, local_time, season, wind_components
from ..operators.clean import drop_sentinels, require_target
from ..operators.timeseries import STATION, fill_gaps, in_slices, lag_columns, rolling_columns, target_columns

LAGS, WINDOWS, HORIZONS = [1, 2, 3, 6, 12, 24, 168], [3, 6, 12, 24], [1, 3, 6, 12, 24]


def temporal(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Local calendar, season and the cyclic pairs."""
    df = df.withColumn("dt_local", local_time(F.col(ts), F.col("country")))
    df = df.withColumns(calendar(F.col("dt_local")))
    hour, month = cyclic(F.col("hour"), 24), cyclic(F.col("month"), 12)
    return df.withColumns({"season": season(F.col("month")), "hour_sin": hour[0], "hour_cos": hour[1], "month_sin": month[0], "month_cos": month[1]}).drop("dt_local")


def feature_table(wide: DataFrame, weather: DataFrame | None = None, lags=tuple(LAGS), windows=tuple(WINDOWS), keys=STATION, ts: str = "ts", horizons: tuple[int, ...] = ()) -> DataFrame:
    """The rows are dealt by parts of a station twice: to fill gaps, and with a halo for all lags and rolling values.

    The weather is joined before the first window: both sides come out of an aggregation by the
    join's keys, so the join needs no exchange of its own. Without ``weather`` the rows have its columns already.
    Targets of ``horizons`` come from the same parts as the lags.
    """
    x = require_target(drop_sentinels(wide))
    if weather is not None:
        x = x.join(weather, [*keys, ts], "left")
    x = fill_gaps(x, ["no2", "pm10", "wind_speed", "wind_direction"], keys, ts)
    u, v = wind_components(F.col("wind_speed"), F.col("wind_direction"))
    x = temporal(x.withColumns({"wind_u": u, "wind_v": v}), ts)
    pollutants = ["pm25", "no2", "pm10"]
    new = lambda k: {**lag_columns(pollutants, list(lags), k, ts), **rolling_columns(pollutants, list(windows), k, ts), **target_columns("pm25", list(horizons), k, ts)}
    return in_slices(x, lambda rows, k: rows.withColumns(new(k)), max(*lags, *windows), max(horizons, default=0), keys, ts)
