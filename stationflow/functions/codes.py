"""Sampling-point and country codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country names and their codes.
COUNTRY_CODES = {
    "Austria": "AT", "Belgium": "BE", "Spain": "ES", "Finland": "FI", "France": "FR", "Germany": "DE", "Italy": "IT",
    "Netherlands": "NL", "Poland": "PL", "Sweden": "SE", "Denmark": "DK", "Norway": "NO", "Greece": "GR", "Portugal": "PT",
    "Czechia": "CZ", "Hungary": "HU", "Romania": "RO", "Bulgaria": "BG", "Croatia": "HR", "Slovakia": "SK", "Slovenia": "SI",
    "Estonia": "EE", "Latvia": "LV", "Lithuania": "LT", "Luxembourg": "LU", "Malta": "MT", "Cyprus": "CY", "Ireland": "IE",
    "United Kingdom": "GB", "Switzerland": "CH", "Iceland": "IS", "Albania": "AL", "Andorra": "AD",
    "Bosnia and Herzegovina": "BA", "Georgia": "GE", "Kosovo under UNSCR 1244/99": "XK", "Montenegro": "ME",
    "North Macedonia": "MK", "Serbia": "RS", "Türkiye": "TR", "Ukraine": "UA",
}
# Site-number patterns by country.
SITE_PATTERNS = {
    "DE": r"DE_([A-Z0-9]+)", "ES": r"^ES/SP_(\d+)", "FR": r"FR(\d+)", "IT": r"IT(\d+[A-Z])", "PL": r"PL(\d+[A-Z])",
    "RO": r"RO(\d+[A-Z])", "SE": r"SE(\d+)", "AT": r"\.09\.([A-Z]+)\.", "FI": r"FI(\d{5})", "BE": r"BE([A-Z]{2}\d+)",
}
# Station-code patterns by country, on the part after the slash.
EOI_PATTERNS = {"FI": r"SPO-(FI\d{5})", "FR": r"SPO-(FR\d{5})", "BE": r"SPO-(BE[A-Z0-9]+)", "AT": r"SPO\.09\.([A-Z0-9]+)\.", "ES": r"SP_(\d+)"}
# Numeric codes inside Austrian and Spanish sampling points.
AT_POINT, AT_METADATA, ES_POINT = r"\.(\d+)\.(\d+)\.1", r"\.(\d+)\.\d+\.", r"SP_(\d+)"


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a fixed dictionary; NULL for a key that it lacks."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def first_group(text: Column, pattern: str) -> Column:
    """The pattern's first group where it is found, else NULL."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def country_of(point: Column) -> Column:
    """Text before the first slash."""
    return F.split_part(point, F.lit("/"), F.lit(1))


def _by_country(country: Column, text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in patterns.items():
        out = F.when(country == code, first_group(text, pattern)).otherwise(out)
    return out


def site_number(point: Column) -> Column:
    """The country's site number inside a sampling point; NULL for no match or an unknown country."""
    return _by_country(country_of(point), point, SITE_PATTERNS)


def eoi_code(point: Column) -> Column:
    """The station code inside the part after the slash; NULL without one."""
    rest = F.when(F.contains(point, F.lit("/")), F.regexp_replace(point, r"^[^/]*/", ""))
    return _by_country(country_of(point), rest, EOI_PATTERNS)


def country_code(name: Column) -> Column:
    return lookup(name, COUNTRY_CODES)


def station_key(country: str = "country", site: str = "site_number") -> Column:
    return F.concat_ws("_", F.col(country), F.col(site))
