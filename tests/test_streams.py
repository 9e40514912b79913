import math
import random

import pytest
from pyspark.sql import functions as F

from stationflow.operators import timeseries
from stationflow.operators.evaluate import metrics_of_sums, running_sums
from stationflow.streaming import running

START = 1_704_067_200


def predictions(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice(["AT", "BE"]), i, START + 60 * i, rng.random(), rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "country string, id long, t long, y_true double, y_pred double").withColumn("ts", F.timestamp_seconds("t"))


def same(a, b):
    key = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    return key(a) == key(b)


def test_a_killed_and_replayed_stream_equals_the_batch(spark, tmp_path, monkeypatch):
    df = predictions(spark)
    folder = str(tmp_path / "in")
    for k in range(6):
        # every file repeats some predictions of the file before
        df.where(F.col("id").between(50 * k - 5, 50 * k + 49)).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path, checkpoint = str(tmp_path / "sums"), str(tmp_path / "checkpoint")
    add, seen = running.add_batch, []

    def killed(batch, batch_id, *more):
        add(batch, batch_id, *more)
        seen.append(batch_id)
        if len(seen) == 3:
            raise RuntimeError("killed after the version was written, before the batch was marked as done")

    monkeypatch.setattr(running, "add_batch", killed)
    q = running.keep_running_sums(stream(), path, checkpoint, ["country"], ["id"], availableNow=True)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination()
    assert running._versions(spark, path)[-1] == 2
    q = running.keep_running_sums(stream(), path, checkpoint, ["country"], ["id"], availableNow=True)
    q.awaitTermination()
    assert seen.count(2) == 2 and len(running._versions(spark, path)) == 2  # the batch came again; older versions are gone
    assert same(running.read_running_metrics(spark, path), metrics_of_sums(running_sums(df, ["country"])))


def test_versions_without_a_success_mark_are_not_read(spark, tmp_path):
    df, path = predictions(spark, 20), str(tmp_path / "sums")
    with pytest.raises(ValueError):
        running.read_running_metrics(spark, path)
    running.add_batch(df, 0, path, ["country"])
    running.add_batch(df, 1, path, ["country"])
    (tmp_path / "sums" / "batch-1" / "_SUCCESS").unlink()
    assert same(running.read_running_metrics(spark, path), metrics_of_sums(running_sums(df, ["country"])))
    running.add_batch(df, 1, path, ["country"])
    running.add_batch(df, 1, path, ["country"])
    assert same(running.read_running_metrics(spark, path), metrics_of_sums(running_sums(df.union(df), ["country"])))


@pytest.mark.parametrize("seed", [1, 2])
def test_arriving_windows_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [("AT", s, START + 3600 * h, rng.random() if rng.random() > 0.05 else None) for s in "ab" for h in range(120) if rng.random() > 0.1 and not 60 < h < 66]
    rows += [("BE", "silent", START + 3600 * h, float(h)) for h in range(30)]
    schema = "country string, site_number string, t long, pm25 double"
    frame = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.timestamp_seconds("t"))
    # out of order within five hours, some rows twice
    arriving = sorted([*rows, *rng.sample(rows, 30)], key=lambda r: r[2] + rng.randrange(5 * 3600))
    folder = str(tmp_path / "in")
    for k in range(0, len(arriving), 60):
        frame(arriving[k : k + 60]).coalesce(1).write.mode("append").parquet(folder)
    for k in (1, 2):  # pushes the watermark past all rows
        frame([("ZZ", "end", START + 3600 * 2000 * k, 1.0)]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = running.arriving_windows(stream, "pm25", [1, 24], [1, 3], 5, late="12 hours")
    q = found.writeStream.format("memory").queryName(f"arriving{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["site_number"], r["ts"]): tuple(r)[3:] for r in spark.table(f"arriving{seed}").where("country <> 'ZZ'").collect()}
    batch = timeseries.eligible(timeseries.time_lags(frame(rows), ["pm25"], [1, 24]), ["pm25"], "pm25", [1, 3], 5)
    expected = {(r["site_number"], r["ts"]): (r["pm25"], r["pm25_lag_1h"], r["pm25_lag_24h"], r["y_h1"], r["y_h3"], r["eligible_h1"], r["eligible_h3"]) for r in batch.collect()}
    clean = lambda t: tuple(None if isinstance(v, float) and math.isnan(v) else v for v in t)
    assert got.keys() == expected.keys() and any(e[5] for e in expected.values())
    for k, e in expected.items():
        assert clean(got[k]) == e, k
