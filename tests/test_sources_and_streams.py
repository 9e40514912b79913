import pytest
from pyspark.sql import functions as F

from stationflow.operators import clean, scaling
from stationflow.sources import readers, sinks
from stationflow.streaming import running


def test_measurements_round_trip_and_missing_files(spark, tmp_path):
    df = spark.sql("SELECT 'AT/x' AS Samplingpoint, TIMESTAMP '2024-01-01 00:00:00' AS Start, CAST('NaN' AS DOUBLE) AS Value, 1 AS extra")
    sinks.land(df, str(tmp_path / "pm10"))
    sinks.land(df.union(df), str(tmp_path / "pm10"))  # what is there stays
    x = readers.read_all(spark, {"PM10": str(tmp_path / "pm10"), "NO2": str(tmp_path / "none")})
    assert x.columns == ["Samplingpoint", "Start", "Value", "PollutantName"] and [tuple(r)[2:] for r in x.collect()] == [(None, "PM10")]
    with pytest.raises(ValueError):
        readers.read_all(spark, {"NO2": str(tmp_path / "none")})


def test_half_years(spark):
    got = [(r["label"], str(r["end"])) for r in readers.half_years(spark, 2022, 2023).orderBy("start").collect()]
    assert got == [("2022H1", "2022-06-30 23:59:00"), ("2022H2", "2022-12-31 23:59:00"), ("2023H1", "2023-06-30 23:59:00"), ("2023H2", "2023-12-31 23:59:00")]


def test_csv_with_bad_timestamps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at\n1,2024-01-01 00:00:00\n2,nonsense\n")
    assert [r["at"] is None for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, at string", ("at",)).orderBy("id").collect()] == [False, True]


def test_metadata_keeps_the_first_row_per_station(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Country,Air Quality Station EoI Code,Air Quality Station Nat Code,Sampling Point Id,Latitude,Longitude,Altitude,Air Quality Station Type,Air Quality Station Area\nAustria,E1,1,p,1.0,2.0,3.0,traffic,urban\nAustria,E1,1,p,9.0,2.0,3.0,traffic,urban\nNowhere,E2,1,p,1.0,2.0,3.0,,\n")
    got = sorted((r["country"], r["eoi"], r["latitude"]) for r in readers.read_metadata(spark, str(tmp_path / "m.csv")).fillna("-").collect())
    assert got == [("-", "E2", 1.0), ("AT", "E1", 1.0)]


def test_metrics_scan_tags_files(spark, tmp_path):
    for name, extra in (("lgb_metrics", ""), ("persistence_metrics", "")):
        (tmp_path / f"{name}.csv").write_text("Scope,Group,horizon,MAE,RMSE,R2,Bias,Count\nGlobal,All,1,1.0,2.0,0.5,0.0,3\n")
    x = readers.read_metrics(spark, [str(tmp_path / "lgb_metrics.csv"), str(tmp_path / "persistence_metrics.csv")], {"lgb_metrics": "LightGBM"})
    assert [(r["stem"], r["model"]) for r in x.collect()] == [("lgb_metrics", "LightGBM")]
    (tmp_path / "bad.csv").write_text("Scope,Group\nGlobal,All\n")
    with pytest.raises(ValueError):
        readers.read_metrics(spark, [str(tmp_path / "bad.csv")])


def test_small_stores_round_trip(spark, tmp_path):
    path = str(tmp_path / "best")
    assert sinks.read_parameters(spark, path) is None
    sinks.write_parameters(spark, {"h1": {"depth": 3, "rate": 0.1}}, path)
    assert sinks.read_parameters(spark, path) == {"h1": {"depth": 3.0, "rate": 0.1}}
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "station_key string, x double")
    sc = scaling.station_scalers(df, ["x"], ["station_key"])
    back = sinks.scalers_of_json(sinks.scalers_json(sc, "station_key"), "station_key")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sc.select("station_key", "feature", "mean", "std").collect()))
    sinks.write_lines(df.select("station_key"), str(tmp_path / "list"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b"]


def test_parameters_are_tuned_once_and_merged(spark, tmp_path):
    path, asked = str(tmp_path / "best"), []
    tune = lambda h: asked.append(h) or {"depth": float(len(h))}
    assert sinks.load_or_tune(spark, path, ["h1"], tune) == {"h1": {"depth": 2.0}}
    assert sinks.load_or_tune(spark, path, ["h1", "h24"], tune) == {"h1": {"depth": 2.0}, "h24": {"depth": 3.0}} and asked == ["h1", "h24"]
    assert sinks.read_parameters(spark, path).keys() == {"h1", "h24"}


def test_run_info_counts_rows_with_a_target(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "y_h1 double, y_h3 double")
    info = sinks.run_info(df, df.limit(1), df.where("false"), [1, 3], {1: 2.5, 3: 4.0})
    assert sorted(map(tuple, info.select("horizon", "train_n", "val_n", "test_n", "seconds").collect())) == [(1, 2, 1, 0, 2.5), (3, 1, 0, 0, 4.0)]
    sinks.write_json(info, str(tmp_path / "info"))
    assert spark.read.json(str(tmp_path / "info")).count() == 2


def test_csv_keeps_its_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, x string")
    sinks.write_csv(df, str(tmp_path / "x"), ["id"])
    sinks.write_csv(df, str(tmp_path / "y"))
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n)).collect()
    assert [r["x"] for r in read("x")] == ["a", "b", "c"] and sorted(r["x"] for r in read("y")) == ["a", "b", "c"]
    assert dict(clean.as_float(df, ["id"]).dtypes)["id"] == "float"


def test_a_scratch_folder_is_shared_until_it_is_cleared(spark):
    import os

    folder = sinks.scratch(spark)
    assert folder != sinks.scratch(spark)
    sinks.write_csv(spark.range(3), folder)
    local = folder.removeprefix("file:")
    assert os.path.isdir(local)
    sinks.clear(spark)
    assert not os.path.exists(local)


def test_feature_lists(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, True)], "site_number string, pm25 double, no2 double, y_h1 double, StationArea_urban boolean")
    assert clean.select_features(df) == ["no2", "StationArea_urban"]
    assert clean.sequence_features(df) == ["StationArea_urban", "pm25", "no2"] and len(clean.SEQUENCE_FEATURES) == 76
    with pytest.raises(ValueError):
        clean.sequence_features(df.drop("pm25"))
    assert clean.one_hour_features(df) == ["no2", "StationArea_urban"]
    assert clean.feature_catalogue(df, {"area": "StationArea_"}).where("feature_group = 'area'").count() == 1


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = [("AT", h, h * 3600, float(h), h + 0.5) for h in (0, 1, 3, 6, 7, 11)]
    df = spark.createDataFrame(rows, "country string, horizon int, t long, y_true double, y_pred double").withColumn("ts", F.timestamp_seconds("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def result(query, name, mode):
        q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    assert result(running.running_metrics(stream(), ["country"]), "running", "complete") == sorted(map(tuple, running.running_metrics(df, ["country"]).collect()))
    batch = running.gap_sessions(df, ["country"])
    assert result(running.gap_sessions(stream(), ["country"]), "sessions", "complete") == sorted(map(tuple, batch.collect())) and batch.count() == 3
