"""Time, weather, label and number functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import lookup

# Time zones by country code.
TIME_ZONES = {
    "AT": "Europe/Vienna", "FR": "Europe/Paris", "ES": "Europe/Madrid", "BE": "Europe/Brussels", "FI": "Europe/Helsinki",
    "DE": "Europe/Berlin", "IT": "Europe/Rome", "NL": "Europe/Amsterdam", "SE": "Europe/Stockholm", "NO": "Europe/Oslo",
    "DK": "Europe/Copenhagen", "PL": "Europe/Warsaw", "CZ": "Europe/Prague", "PT": "Europe/Lisbon", "GR": "Europe/Athens",
    "UK": "Europe/London",
}


def utc_of_start(start: Column) -> Column:
    """Source timestamps stand one hour before UTC all year."""
    return start - F.expr("INTERVAL 1 HOUR")


def time_zone(country: Column) -> Column:
    return F.coalesce(lookup(country, TIME_ZONES), F.lit("UTC"))


def local_time(utc: Column, country: Column) -> Column:
    """Local wall clock, summer time included; UTC for an unknown country."""
    return F.from_utc_timestamp(utc, time_zone(country))


def calendar(local: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0), day_of_month, month, year and is_weekend."""
    return {
        "hour": F.hour(local), "day_of_week": F.weekday(local), "day_of_month": F.dayofmonth(local), "month": F.month(local),
        "year": F.year(local), "is_weekend": (F.weekday(local) >= 5).cast("int"),
    }


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isNotNull(), "Fall")


def season_number(name: Column) -> Column:
    """0 to 3 from winter on; Autumn is Fall; -1 for anything else."""
    return F.when(name == "Winter", 0).when(name == "Spring", 1).when(name == "Summer", 2).when(name.isin("Fall", "Autumn"), 3).otherwise(-1)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """speed x (cos, sin) of the direction in degrees, as the data model defines them."""
    return speed * F.cos(F.radians(direction)), speed * F.sin(F.radians(direction))


def one_hot(value: str, categories: list[str], prefix: str) -> list[Column]:
    """A boolean per declared category; NULL is false in all."""
    return [F.coalesce(F.col(value) == c, F.lit(False)).alias(f"{prefix}_{c}") for c in categories]


def label_by_argmax(prefix: str, categories: list[str]) -> Column:
    """The first true category; all false gives the first one, none at all ``Unknown``."""
    if not categories:
        return F.lit("Unknown")
    out = F.lit(categories[0])
    for c in reversed(categories):
        out = F.when(F.col(f"`{prefix}_{c}`"), c).otherwise(out)
    return out


def label_by_priority(prefix: str, categories: list[str]) -> Column:
    """The first true category in the given order, else ``unknown``."""
    out = F.lit("unknown")
    for c in reversed(categories):
        out = F.when(F.col(f"`{prefix}_{c}`"), c).otherwise(out)
    return out


def finite(value: Column) -> Column:
    """Infinity and NaN read as NULL."""
    return F.when(F.abs(value) < F.lit(math.inf), value)


def non_negative(value: Column) -> Column:
    """Negative values are sentinels and read as NULL, and so does NaN."""
    return F.when((value >= 0) & ~F.isnan(value), value)


def winner(p: Column, statistic: Column, level: float = 0.05) -> Column:
    """model1 for a significant negative statistic, model2 for a positive one, else tie."""
    return F.when(p < level, F.when(statistic < 0, "model1").otherwise("model2")).otherwise("tie")


def number_text(value: Column, digits: int = 2) -> Column:
    """Fixed decimals with thousands separators; blank for NULL."""
    return F.coalesce(F.format_number(value, digits), F.lit(""))


def degradation(base: Column, other: Column) -> Column:
    """Per cent of the base by which the other is larger; NULL for a zero base."""
    return 100 * (other - base) / F.nullif(base, F.lit(0.0))


def student_p(statistic: float, df: int) -> float:
    """Two-sided p-value of Student's t by the regularised incomplete beta function (continued fraction)."""
    x, a, b = df / (df + statistic * statistic), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
        out = d
        for m in range(1, 400):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + n * d) or tiny), (1 + n / c) or tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return min(1.0, 1 - front * fraction(b, a, 1 - x) / b)
