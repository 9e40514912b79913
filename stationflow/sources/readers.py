"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import country_code

# Columns of the input files.
MEASUREMENTS = "Samplingpoint string, Start timestamp, Value double, PollutantName string"
METADATA = "Country string, `Air Quality Station EoI Code` string, `Air Quality Station Nat Code` string, `Sampling Point Id` string, Latitude double, Longitude double, Altitude double, `Air Quality Station Type` string, `Air Quality Station Area` string"


def read_measurements(spark: SparkSession, path: str, pollutant: str) -> DataFrame | None:
    """One pollutant's Parquet files, four columns, tagged with its name; None (with a warning) where nothing is."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        print(f"skipped {path}: {e.getCondition()}")
        return None
    return found.select("Samplingpoint", F.col("Start").cast("timestamp").alias("Start"), F.when(~F.isnan("Value"), F.col("Value")).alias("Value"), F.lit(pollutant).alias("PollutantName"))


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All pollutants in one long table; an error if none is there."""
    found = [x for pollutant, path in paths.items() if (x := read_measurements(spark, path, pollutant)) is not None]
    if not found:
        raise ValueError("no pollutant file is present")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def half_years(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(label, start, end) of each half-year; the end is its last day at 23:59."""
    starts = F.sequence(F.lit(f"{first_year}-01-01").cast("timestamp"), F.lit(f"{last_year}-07-01").cast("timestamp"), F.expr("INTERVAL 6 MONTHS"))
    s = spark.range(1).select(F.explode(starts).alias("start"))
    return s.select(F.concat(F.year("start"), F.when(F.month("start") == 1, "H1").otherwise("H2")).alias("label"), "start", (F.add_months("start", 6).cast("timestamp") - F.expr("INTERVAL 1 MINUTE")).alias("end"))


def half_year_of(ts: str):
    return F.concat(F.year(ts), F.when(F.quarter(ts) <= 2, "H1").otherwise("H2"))


def read_csv(spark: SparkSession, path: str, schema: str, timestamps: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; unreadable timestamps are NULL."""
    texts = spark.read.option("header", True).schema(schema).csv(path)
    return texts.withColumns({c: F.try_to_timestamp(F.col(c)) for c in timestamps})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stations: country code, codes and place; the first row per (country, eoi) in file order."""
    raw = spark.read.option("header", True).schema(METADATA).csv(path).withColumn("file_order", F.monotonically_increasing_id())
    s = raw.select(
        country_code(F.col("Country")).alias("country"), F.col("Air Quality Station EoI Code").alias("eoi"), F.col("Air Quality Station Nat Code").alias("nat_code"),
        F.col("Sampling Point Id").alias("sampling_point_id"), F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"), F.col("Altitude").alias("altitude"),
        F.col("Air Quality Station Type").alias("station_type"), F.col("Air Quality Station Area").alias("station_area"), "file_order",
    )
    w = Window.partitionBy("country", "eoi").orderBy("file_order")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# The columns of metrics files, in any order and number; others are left out.
METRICS_COLUMNS = """Scope string, `Group` string, horizon int, MAE double, RMSE double, R2 double, Bias double, Count long, MAE_persistence double, RMSE_persistence double,
  skill_vs_persistence_mae double, MAE_skill double, RMSE_skill double"""
#: Columns that every metrics file must have.
REQUIRED = ("Scope", "Group", "horizon", "MAE", "RMSE")
#: Most columns of a metrics file.
WIDEST = 32


def _scan_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(stem, header, fields) of every line of any number of CSV files, in one scan: a file's columns are told by its own header.

    A file is a path, or a folder of part files that Spark wrote; every part has the header.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path")).where("trim(value) <> ''")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    names = ", ".join(f"c{i} string" for i in range(WIDEST))
    parsed = F.from_csv("value", names)
    fields = F.array(*[F.trim(parsed[f"c{i}"]) for i in range(WIDEST)])
    x = lines.select("path", F.try_url_decode(stem).alias("stem"), fields.alias("fields"))
    has = lambda name: F.coalesce(F.array_contains("fields", name), F.lit(False))
    is_header = has("Scope") & (has("horizon") | has("Group"))
    headers = x.where(is_header).groupBy("path").agg(F.first("fields").alias("header"))
    return x.where(~is_header).join(headers, "path", "left")


def _by_name(lines: DataFrame) -> DataFrame:
    """The known columns of each line by its file's header; NULL where the file has none such."""
    wanted = [(f.name, f.dataType) for f in T.StructType.fromDDL(METRICS_COLUMNS)]
    value = lambda name: F.when(F.array_contains("header", name), F.element_at("fields", F.array_position("header", name).cast("int")))
    return lines.select("stem", *[value(n).try_cast(t).alias(n) for n, t in wanted])


def _lacking(lines: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(stem, missing columns) of the files that lack some; one aggregate over all files."""
    missing = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("header", F.array().cast("array<string>")))
    return lines.groupBy("stem").agg(F.first(missing).alias("missing")).where("size(missing) > 0")


def read_model_metrics(spark: SparkSession, folder: str, models: dict[str, dict[str, str]], protocol: str, skill: bool = False) -> DataFrame:
    """Metrics of the models of one protocol, with their labels; one scan of the folder for any number of models.

    ``models`` has for each model its ``label``, and the file's stem by protocol. A baseline column is
    dropped; files that are missing or (``skill``) lack the skill columns are left out with a warning.
    """
    known = {about[protocol]: (name, about["label"]) for name, about in models.items() if protocol in about}
    wanted = (*REQUIRED, *(("MAE_skill", "RMSE_skill") if skill else ()))
    if not known:
        raise ValueError(f"no metrics of protocol {protocol} are present")
    try:
        lines = _scan_metrics(spark, [f"{folder}/{{{','.join(f'{s},{s}.csv' for s in known)}}}"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no metrics of protocol {protocol} are present") from e
    bad = {r["stem"]: r["missing"] for r in _lacking(lines, wanted).collect()}  # at most one row a model
    for stem, missing in sorted(bad.items()):
        print(f"skipped {stem}: it lacks {', '.join(missing)}")
    tags = F.create_map(*[F.lit(v) for stem, (name, _) in known.items() for v in (stem, name)]), F.create_map(*[F.lit(v) for stem, (_, label) in known.items() for v in (stem, label)])
    rows = _by_name(lines.where(~F.col("stem").isin(sorted(bad)))) if bad else _by_name(lines)
    return rows.withColumns({"model": tags[0][F.col("stem")], "label": tags[1][F.col("stem")], "protocol": F.lit(protocol)}).drop("stem")


def read_metrics(spark: SparkSession, paths: list[str], models: dict[str, str] | None = None, skip: str = "persistence") -> DataFrame:
    """Metrics files with their stem (and model name), in one scan; files whose names contain ``skip`` (in any case) are left out, and so is a baseline column."""
    chosen = [p for p in paths if not (skip and skip.lower() in p.rstrip("/").rsplit("/", 1)[-1].lower())]
    if not chosen:
        raise ValueError("no metrics file is present")
    lines = _scan_metrics(spark, chosen)
    if bad := _lacking(lines, REQUIRED).first():
        raise ValueError(f"{bad['stem']} lacks {', '.join(bad['missing'])}")
    named = F.create_map(*[F.lit(v) for pair in (models or {}).items() for v in pair]) if models else None
    return _by_name(lines).withColumn("model", F.coalesce(named[F.col("stem")], F.col("stem")) if named is not None else F.col("stem"))
