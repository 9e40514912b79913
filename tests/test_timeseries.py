import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationflow.operators import timeseries as ts

START = 1_704_067_200


def frame(spark, rows):
    """rows: (site, hour, value)"""
    df = spark.createDataFrame([("AT", s, START + h * 3600, v) for s, h, v in rows], "country string, site_number string, t long, pm25 double")
    return df.selectExpr("country", "site_number", "timestamp_seconds(t) AS ts", "pm25", f"(t - {START}) DIV 3600 AS h")


def test_lags_are_null_across_gaps(spark):
    x = ts.time_lags(frame(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 4.0), ("b", 0, 9.0)]), ["pm25"], [1, 2])
    got = {(r["site_number"], r["h"]): (r["pm25_lag_1h"], r["pm25_lag_2h"]) for r in x.collect()}
    assert got == {("a", 0): (None, None), ("a", 1): (1.0, None), ("a", 3): (None, 2.0), ("b", 0): (None, None)}


def test_a_two_hour_gap_keeps_the_segment_and_a_three_hour_gap_breaks_it(spark):
    x = ts.segments(frame(spark, [("a", h, 1.0) for h in (0, 1, 3, 6, 7)]))
    assert [(r["h"], r["segment_id"], r["segment_pos"], r["segment_len"]) for r in x.orderBy("h").collect()] == [(0, 0, 1, 3), (1, 0, 2, 3), (3, 0, 3, 3), (6, 1, 1, 2), (7, 1, 2, 2)]


@pytest.mark.parametrize("values, expected", [([None, 1.0, None, None, 4.0, None], [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]), ([None, None], [None, None]), ([5.0], [5.0])])
def test_gap_fill(spark, values, expected):
    x = ts.fill_gaps(frame(spark, [("a", i, v) for i, v in enumerate(values)]), ["pm25"])
    assert [r["pm25"] for r in x.orderBy("h").collect()] == expected


def test_gap_fill_by_time_weighs_hours(spark):
    x = ts.fill_gaps(frame(spark, [("a", 0, 0.0), ("a", 1, None), ("a", 4, 4.0)]), ["pm25"], method="time")
    assert [r["pm25"] for r in x.orderBy("h").collect()] == [0.0, 1.0, 4.0]


def test_gap_fill_uses_running_frames_only(spark):
    x = ts.fill_gaps(frame(spark, [("a", 0, 1.0)]), ["pm25"])
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_gap_fill_of_a_long_series_takes_linear_time(spark):
    long = spark.range(200_000).selectExpr("'AT' AS country", "'a' AS site_number", "timestamp_seconds(id * 3600) AS ts", "IF(id % 5 = 0, CAST(id AS DOUBLE), NULL) AS pm25")
    began = time.monotonic()
    assert ts.fill_gaps(long, ["pm25"]).where("abs(pm25 - unix_timestamp(ts) / 3600) > 1e-6 AND unix_timestamp(ts) < 199995 * 3600L").count() == 0
    assert time.monotonic() - began < 30


def test_rolling_and_targets_against_pandas(spark):
    rng = random.Random(5)
    rows = [(s, h, rng.random() if rng.random() > 0.1 else None) for s in "ab" for h in range(120) if rng.random() > 0.2]
    x = ts.targets(ts.rolling(frame(spark, rows), ["pm25"], [3, 24]), "pm25", [1, 6]).orderBy("site_number", "h").toPandas()
    for _, g in x.groupby("site_number"):
        g = g.set_index("ts")
        grid = g["pm25"].reindex(pd.date_range(g.index.min(), g.index.max(), freq="h"))
        for n in (3, 24):
            pd.testing.assert_series_equal(g[f"pm25_rolling_mean_{n}h"], grid.rolling(f"{n}h", min_periods=1).mean().reindex(g.index), check_names=False, check_freq=False)
            pd.testing.assert_series_equal(g[f"pm25_rolling_std_{n}h"], grid.rolling(f"{n}h", min_periods=2).std().reindex(g.index), check_names=False, check_freq=False, atol=1e-9)
        for h in (1, 6):
            pd.testing.assert_series_equal(g[f"y_h{h}"], grid.shift(-h).reindex(g.index), check_names=False, check_freq=False)


def test_sequences_hold_the_last_rows_in_order(spark):
    x = ts.sequences(ts.segments(frame(spark, [("a", h, float(h)) for h in range(6)])), ["pm25"], 3, F.lit(True))
    assert [[v[0] for v in r["sequence"]] for r in x.orderBy("h").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5]]


def test_eligible_needs_lookback_and_room_ahead(spark):
    x = ts.eligible(frame(spark, [("a", h, float(h)) for h in range(8)]), ["pm25"], "pm25", [1, 2], 3)
    got = [(r["h"], r["eligible_h1"], r["eligible_h2"]) for r in x.orderBy("h").collect()]
    assert [h for h, a, _ in got if a] == [2, 3, 4, 5, 6] and [h for h, _, b in got if b] == [2, 3, 4, 5]


def test_densify_and_first_per_key(spark):
    x = frame(spark, [("a", 0, 1.0), ("a", 3, 2.0)])
    assert ts.densify(x).count() == 4
    twice = frame(spark, [("a", 0, 1.0), ("a", 0, 2.0)])
    assert [r["pm25"] for r in ts.first_per_key(twice, ["site_number", "ts"], [F.col("pm25").desc()]).collect()] == [2.0]


# --- series that are larger than a task ------------------------------------------------------------


def plain(rows, longest_gap=2, lookback=4):
    """Each row's gap, segment, position, length, complete lookback and filled value, by one loop a site."""
    out, by_site = {}, {}
    for s, h, v in sorted(rows, key=lambda r: r[:2]):
        by_site.setdefault(s, []).append((h, v))
    for s, seq in by_site.items():
        ids, starts = [], []
        for i, (h, _) in enumerate(seq):
            new = i == 0 or h - seq[i - 1][0] > longest_gap
            ids.append((ids[-1] if ids else -1) + new)
            starts.append(i if new else starts[-1])
        known = [i for i, (_, v) in enumerate(seq) if v is not None]
        for i, (h, v) in enumerate(seq):
            a, b = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
            filled = v if v is not None else None if not known else seq[b][1] if a is None else seq[a][1] if b is None else seq[a][1] + (seq[b][1] - seq[a][1]) * (i - a) / (b - a)
            recent = seq[max(starts[i], i - lookback + 1) : i + 1]
            out[s, h] = (None if i == 0 else h - seq[i - 1][0], ids[i], i - starts[i] + 1, ids.count(ids[i]), all(x is not None for _, x in recent), filled)
    return out


def long_station(seed, hours=400, keep=0.75):
    rng = random.Random(seed)
    rows = [(s, h, rng.random() if rng.random() > 0.4 else None) for s in "ab" for h in range(hours) if rng.random() < keep]
    rows = [r for r in rows if not 100 < r[1] < 180]  # several parts without any row
    return rows + [("c", 7, None), ("c", 300, None), ("d", 50, 1.0)]


@pytest.fixture
def short_parts(monkeypatch):
    monkeypatch.setattr(ts, "SPAN", 16)


@pytest.mark.parametrize("seed, keep", [(1, 0.75), (2, 0.3), (3, 1.0)])
def test_scans_over_many_parts_equal_one_loop(spark, short_parts, seed, keep):
    rows = long_station(seed, keep=keep)
    x = frame(spark, rows).repartition(7)
    got = {}
    for part in (ts.gaps(x).select("site_number", "h", "gap_hours"), ts.segments(x, features=["pm25"], lookback=4).select("site_number", "h", "segment_id", "segment_pos", "segment_len", "lookback_ok"), ts.fill_gaps(x, ["pm25"]).select("site_number", "h", "pm25")):
        for r in part.collect():
            got[r[0], r[1]] = got.get((r[0], r[1]), ()) + tuple(r)[2:]
    expected = plain(rows)
    assert got.keys() == expected.keys()
    for k, e in expected.items():
        assert got[k][:5] == e[:5] and got[k][5] == pytest.approx(e[5]), k


def test_windows_over_many_parts_equal_one_part(spark, monkeypatch):
    x = frame(spark, long_station(4))

    def found():
        y = ts.targets(ts.rolling(ts.time_lags(x, ["pm25"], [1, 24, 168]), ["pm25"], [3, 24]), "pm25", [1, 24])
        return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in y.collect()), key=repr)

    whole = found()
    assert len(whole) == x.count()
    monkeypatch.setattr(ts, "SPAN", 5)
    parts = [ts.in_slices(x, lambda rows, k: rows.withColumn("task", F.col("_part")), 24, 6, keep_part=True)]
    assert parts[0].select("task").distinct().count() > 1 and found() == whole


def test_fill_by_time_over_many_parts(spark, short_parts):
    x = ts.fill_gaps(frame(spark, [("a", 0, 0.0), ("a", 30, None), ("a", 70, None), ("a", 100, 10.0), ("a", 200, None)]), ["pm25"], method="time")
    assert [round(r["pm25"], 9) for r in x.orderBy("h").collect()] == [0.0, 3.0, 7.0, 10.0, 10.0]


def test_no_window_over_rows_is_keyed_by_a_station_alone(spark):
    x = frame(spark, [("a", 0, 1.0)])
    y = ts.segments(ts.fill_gaps(ts.rolling(ts.targets(x, "pm25", [1]), ["pm25"], [3]), ["pm25"]), features=["pm25"], lookback=3)
    for z in (ts.gaps(y), ts.anchors(x, ["pm25"], "pm25", [1], 3, "2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-02 00:00:00")):
        plan = z._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "windowspecdefinition" in line:
                # the second level runs over one summary row a part, ordered by the part
                assert all("_part#" in spec for spec in line.split("windowspecdefinition(")[1:]), line


def test_one_long_station_is_dealt_to_many_tasks(spark):
    long = spark.range(60_000).selectExpr("'AT' AS country", "'a' AS site_number", "timestamp_seconds(id * 3600) AS ts", "CAST(id AS DOUBLE) AS pm25")
    tasks = ts.in_slices(long, lambda x, k: x.withColumns(ts.lag_columns(["pm25"], [1, 168], k)).withColumn("task", F.spark_partition_id()), 168)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert tasks.where("pm25_lag_168h <> pm25 - 168 OR (pm25 >= 168 AND pm25_lag_168h IS NULL)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_repeated_times_are_made_one_first(spark):
    x = frame(spark, [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 3.0)])
    one = ts.first_per_key(x, ["country", "site_number", "ts"], [F.col("pm25").desc()])
    assert [(r["segment_pos"], r["pm25_lag_1h"]) for r in ts.time_lags(ts.segments(one), ["pm25"], [1]).orderBy("h").collect()] == [(1, None), (2, 2.0)]


def test_gaps_are_filled_without_a_sort_for_the_parts(spark):
    rows = spark.createDataFrame([("AT", "1", h, v, w) for h, v, w in ((0, None, None), (1, 2.0, None), (4, None, -0.5), (6, 8.0, None), (9, None, None))], "country string, site_number string, h long, v double, w double")
    filled = ts.fill_gaps(rows.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)), ["v", "w"])
    assert "SortAggregate" not in filled._jdf.queryExecution().executedPlan().toString()
    assert [(r["v"], r["w"]) for r in filled.orderBy("h").collect()] == [(2.0, -0.5), (2.0, -0.5), (5.0, -0.5), (8.0, -0.5), (8.0, -0.5)]
