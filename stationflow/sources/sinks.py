"""Sinks and the small JSON stores of parameters, run information and scalers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import dataset_summary, missing_report
from ..operators.sampling import first_per_group, first_rows


#: The folders that ``scratch`` has named, by application.
_scratch: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; a local one where that is unset and Spark is local.

    A lazy result may read it, so it stays until the caller has written that result and calls ``clear``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stationflow-")
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}")
    return _scratch[spark.sparkContext.applicationId][-1]


def clear(spark: SparkSession) -> None:
    """Deletes all scratch folders of this application; for a caller whose results are written."""
    for folder in _scratch.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def land(df: DataFrame, path: str, period: str | None = None, mode: str = "ignore") -> None:
    """Parquet, by period if given; what is there already is left as it is."""
    writer = df.write.mode(mode)
    (writer.partitionBy(period) if period else writer).parquet(path)


def land_periods(df: DataFrame, path: str, period: str, least: int = 1) -> None:
    """Adds the periods (a column) that are not landed yet and have ``least`` rows or more, one folder each."""
    counts = df.groupBy(period).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(period)
    try:
        counts = counts.join(df.sparkSession.read.parquet(path).select(F.col(period).cast(dict(df.dtypes)[period]).alias(period)).distinct(), period, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing is landed yet
            raise
    df.join(counts, period, "left_semi").write.mode("append").partitionBy(period).parquet(path)


def write_summary(df: DataFrame, path: str, columns: list[str]) -> None:
    """The dataset's summary and its missing values by column, as JSON beside the data."""
    write_json(dataset_summary(df), f"{path}/summary")
    write_json(missing_report(df, columns), f"{path}/missing")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One text column, sorted, in one file: a list of sites, bounded by their number."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_parameters(spark: SparkSession, best: dict[str, dict], path: str) -> None:
    """{"h1": {name: value}} as one JSON row per horizon."""
    rows = [(h, name, float(value)) for h, found in best.items() for name, value in found.items()]
    write_json(spark.createDataFrame(rows, "horizon string, name string, value double"), path)


def read_parameters(spark: SparkSession, path: str) -> dict[str, dict] | None:
    """The stored parameters, or None where there are none yet."""
    try:
        rows = spark.read.schema("horizon string, name string, value double").json(path).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    out: dict[str, dict] = {}
    for r in rows:
        out.setdefault(r["horizon"], {})[r["name"]] = r["value"]
    return out


def load_or_tune(spark: SparkSession, path: str, horizons: list[str], tune: Callable[[str], dict]) -> dict[str, dict]:
    """The stored parameters of each horizon; those that are not there yet are tuned and stored with the others."""
    known = read_parameters(spark, path) or {}
    new = {h: tune(h) for h in horizons if h not in known}
    if new:
        write_parameters(spark, known | new, path)
    return {h: (known | new)[h] for h in horizons}


def prediction_sample(predictions: DataFrame, n: int, order: list[str], per: str | None = None) -> DataFrame:
    """The first n predictions in order, or the first n of each ``per`` (horizon)."""
    return first_per_group(predictions, n, [per], order) if per else first_rows(predictions, n, order)


def run_info(train: DataFrame, valid: DataFrame | None, test: DataFrame, horizons: list[int], seconds: dict[int, float] | None = None) -> DataFrame:
    """horizon, train_n, val_n, test_n (rows with the horizon's target) and the fit's seconds, one row per horizon."""
    names = {h: f"y_h{h}" for h in horizons}
    out = None
    for side, df in (("train_n", train), ("val_n", valid), ("test_n", test)):
        if df is None:
            continue
        one = df.agg(*[F.count(c).alias(c) for c in names.values()])
        long = one.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias(side)) for h, c in names.items()])).alias("x")).select("x.*")
        out = long if out is None else out.join(long, "horizon")
    took = F.create_map(*[x for h, t in (seconds or {}).items() for x in (F.lit(h), F.lit(float(t)))]) if seconds else None
    return out.withColumn("seconds", took[F.col("horizon")] if took is not None else F.lit(None).cast("double"))


def scalers_json(scalers: DataFrame, key: str) -> DataFrame:
    """(key, json): each station's {feature: {mean, std}} as one JSON text."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.struct("mean", "std")))))
    return scalers.groupBy(key).agg(F.to_json(entries).alias("json"))


def scalers_of_json(df: DataFrame, key: str) -> DataFrame:
    found = df.select(key, F.explode(F.from_json("json", "map<string, struct<mean: double, std: double>>")).alias("feature", "v"))
    return found.select(key, "feature", "v.mean", "v.std")


def save_model(model: PipelineModel, folder: str, name: str, horizon: int) -> None:
    model.write().overwrite().save(f"{folder}/{name}_h{horizon}")


def load_model(folder: str, name: str, horizon: int) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}_h{horizon}")
