import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.operators import sequences, timeseries
from stationflow.sources import readers

START = 1_704_067_200


def frame(spark, rows):
    df = spark.createDataFrame(rows, "country string, site_number string, h long, a double, b double")
    return df.selectExpr("country", "site_number", "h", f"timestamp_seconds(h * 3600 + {START}) AS ts", "a", "b").repartition(3)


def some_rows(seed=3):
    rng = random.Random(seed)
    rows = [("AT", s, h, rng.gauss(0, 1) if rng.random() > 0.02 else None, float(h)) for s in "xy" for h in range(150) if rng.random() > 0.12]
    return rows + [("BE", "z", 5, 1.0, 2.0)]


def plain_windows(rows, horizons, lookback):
    out, by = {}, {}
    for c, s, h, a, b in sorted(rows, key=lambda r: r[:3]):
        by.setdefault((c, s), []).append((h, a, b))
    for key, seq in by.items():
        segments = []
        for r in seq:
            if not segments or r[0] - segments[-1][-1][0] > 2:
                segments.append([])
            segments[-1].append(r)
        known = {r[0]: r[1] for r in seq}
        for seg in segments:
            for i in range(lookback - 1, len(seg)):
                window = seg[i - lookback + 1 : i + 1]
                if len(seg) < lookback + max(horizons) + 1 or any(v is None for r in window for v in r[1:]):
                    continue
                for h in horizons:
                    y = known.get(seg[i][0] + h)
                    if i + 1 <= len(seg) - h and y is not None:
                        out[(*key, seg[i][0], h)] = ([np.float32(v) for r in window for v in r[1:]], y, seg[i][1])
    return out


@pytest.mark.parametrize("span", [4096, 8, 30])
def test_windows_of_packed_parts_equal_plain_ones(spark, monkeypatch, span):
    monkeypatch.setattr(timeseries, "SPAN", span)
    rows = some_rows()
    packed = sequences.pack(frame(spark, rows), ["a", "b"], "a", [1, 3], 5)
    got = {(r["country"], r["site_number"], (int(r["ts"].timestamp()) - START) // 3600, r["horizon"]): (r["sequence"], r["y_true"], r["y_persistence"]) for r in sequences.read_windows(packed, [1, 3], 5).collect()}
    expected = plain_windows(rows, [1, 3], 5)
    assert got.keys() == expected.keys() and len(got) > 50
    for k, (x, y, now) in expected.items():
        assert np.allclose(got[k][0], x) and got[k][1:] == (y, now)


def test_packed_rows_are_stored_about_once(spark):
    hours = 20_000
    df = spark.range(hours).selectExpr("'AT' AS country", "'x' AS site_number", f"timestamp_seconds(id * 3600 + {START}) AS ts", "CAST(id AS DOUBLE) AS a", "rand(1) AS b", "'id-1' AS station")
    packed = sequences.pack(df, ["a", "b"], "a", [1], 168, keep=F.col("ts") > F.timestamp_seconds(F.lit(START + 3600)), extra=("station",))
    found = packed.select(F.sum("n_rows"), F.sum(F.octet_length("features")), F.count("*"), F.first("station"), F.sum(F.size(F.get("anchors", 0)))).first()
    assert found[0] < 1.15 * hours and found[1] == found[0] * 8 and found[2] >= 5 and found[3] == "id-1" and found[4] == hours - 168
    one = sequences.read_windows(packed.limit(1), [1], 168, extra=("station",)).where("size(sequence) <> 336").count()
    assert one == 0


def test_no_anchor_and_no_rows(spark):
    x = frame(spark, [("AT", "x", h, 1.0, None) for h in range(30)])
    assert sequences.pack(x, ["a", "b"], "a", [1], 5).count() == 0
    assert sequences.read_windows(sequences.pack(x.where("false"), ["a"], "a", [1], 5), [1], 5).count() == 0


# --- metrics files in one scan ---------------------------------------------------------------------


def write(folder, name, header, *lines):
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def test_a_thousand_metrics_files_take_one_plan(spark, tmp_path):
    for i in range(1000):
        header = ["Scope,Group,horizon,MAE,RMSE", "baseline,horizon,Scope,Group,RMSE,MAE,Count"][i % 2]
        write(tmp_path, f"m{i}.csv", header, ["Global,All,1,1.5,2.5", f"x,1,Global,All,2.5,1.5,{i}"][i % 2])
    spark.sparkContext.setJobGroup("files", "files")
    x = readers.read_metrics(spark, [str(tmp_path / f"m{i}.csv") for i in range(1000)], {"m7": "Seven"})
    rows = x.collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("files"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 1000 and all((r["Scope"], r["Group"], r["horizon"], r["MAE"], r["RMSE"]) == ("Global", "All", 1, 1.5, 2.5) for r in rows)
    assert {r["stem"]: r["model"] for r in rows}["m7"] == "Seven" and {r["stem"]: r["Count"] for r in rows}["m9"] == 9 and "baseline" not in x.columns
    assert jobs <= 8  # listing the files, the header check and the scan, with a job a shuffle; not one a file


def test_names_quotes_and_missing_columns(spark, tmp_path):
    write(tmp_path, "lgb.csv", "Scope,Group,horizon,MAE,RMSE,other", '"Station, Area","a ""b""",3,1,2,x')
    write(tmp_path, "My_Persistence.csv", "Scope,Group,horizon,MAE,RMSE", "Global,All,1,1,2")
    r = readers.read_metrics(spark, [str(tmp_path / "lgb.csv"), str(tmp_path / "My_Persistence.csv")]).collect()
    assert [(x["stem"], x["Scope"], x["horizon"], x["RMSE"], x["R2"]) for x in r] == [("lgb", "Station, Area", 3, 2.0, None)]
    with pytest.raises(ValueError, match="no metrics"):
        readers.read_metrics(spark, [str(tmp_path / "My_Persistence.csv")])
    write(tmp_path, "bad.csv", "Scope,Group,MAE", "Global,All,1")
    with pytest.raises(ValueError, match="bad lacks horizon, RMSE"):
        readers.read_metrics(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "lgb.csv")])


def test_models_of_a_protocol(spark, tmp_path, capsys):
    write(tmp_path, "a.csv", "baseline,Scope,Group,horizon,MAE,RMSE,MAE_skill,RMSE_skill", "b,Global,All,1,1,2,3,4")
    write(tmp_path, "b.csv", "Scope,Group,horizon,MAE,RMSE", "Global,All,1,1,2")
    known = {"one": {"label": "One", "A": "a"}, "two": {"label": "Two", "A": "b"}, "three": {"label": "Three", "A": "none"}, "four": {"label": "Four", "B": "b"}}
    r = readers.read_model_metrics(spark, str(tmp_path), known, "A", skill=True).collect()
    assert [(x["model"], x["label"], x["protocol"], x["RMSE_skill"]) for x in r] == [("one", "One", "A", 4.0)] and "skipped b" in capsys.readouterr().out
    assert {x["model"] for x in readers.read_model_metrics(spark, str(tmp_path), known, "A").collect()} == {"one", "two"}
    for folder, protocol in ((str(tmp_path), "C"), (str(tmp_path / "nowhere"), "A")):
        with pytest.raises(ValueError, match="no metrics"):
            readers.read_model_metrics(spark, folder, known, protocol)
