"""Streaming forms: running error metrics, gap sessions, and lags, targets and anchors of arriving rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.evaluate import merge_sums, metrics_of_sums, running_sums
from ..operators.timeseries import HOUR, STATION


def running_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per key over all predictions so far (update or complete mode); the batch form is the same call.

    The state is a few sums per key and is kept for good: no watermark applies, since a late prediction still counts.
    """
    return metrics_of_sums(running_sums(predictions, keys))


# --- sums that outlive a stream --------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table of sums, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and whole(n))


def _forget(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def add_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """Adds a batch's sums to the newest version before it and writes them as the batch's version.

    A batch that is replayed starts from the same version and overwrites its own, so it counts once; a version
    that was cut off has no success mark and is not read. The two newest versions are kept.
    """
    spark = batch.sparkSession
    sums, before = running_sums(batch, keys), [v for v in _versions(spark, path) if v < batch_id]
    if before:
        sums = merge_sums(spark.read.parquet(f"{path}/batch-{before[-1]}").unionByName(sums), keys)
    sums.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
    for v in before[:-1]:
        _forget(spark, f"{path}/batch-{v}")


def keep_running_sums(predictions: DataFrame, path: str, checkpoint: str, keys: list[str], ids: list[str], ts: str = "ts", late: str = "7 days", **trigger) -> StreamingQuery:
    """Starts a stream that keeps the sums of ``keys`` in a table of versions at ``path`` (in a folder that all executors share).

    A prediction that comes again within ``late`` (the same ``ids``) counts once.
    """
    once = predictions.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)
    writer = once.writeStream.foreachBatch(lambda batch, i: add_batch(batch, i, path, keys)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_running_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of the newest complete version."""
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"there are no sums at {path} yet")
    return metrics_of_sums(spark.read.parquet(f"{path}/batch-{found[-1]}"))


# --- sessions ------------------------------------------------------------------------------------


def gap_sessions(measurements: DataFrame, keys: list[str], ts: str = "ts", longest_gap: str = "2 hours 1 second", late: str = "24 hours") -> DataFrame:
    """Runs of rows whose gaps are at most two hours: start, last row's time and rows per session."""
    marked = measurements.withWatermark(ts, late) if measurements.isStreaming else measurements
    found = marked.groupBy(*keys, F.session_window(ts, longest_gap).alias("w")).agg(F.count("*").alias("n_rows"), F.max(ts).alias("last_ts"))
    return found.select(*keys, F.col("w.start").alias("start_ts"), "last_ts", "n_rows")


# --- windows over arriving rows --------------------------------------------------------------------


def arriving_windows(rows: DataFrame, column: str, lags: list[int], horizons: list[int], lookback: int, late: str = "24 hours", longest_gap: int = 2, keys=STATION, ts: str = "ts") -> DataFrame:
    """keys, ts, the column, its lags, targets y_h{h} and eligible_h{h} of a stream of rows, each once, when they can no longer change.

    A station's state is the rows of the last hours that lags, lookback or open targets reach, and the position of the
    first of them in its segment. Rows come in any order within ``late``; of rows with one time the smallest value that came first stays;
    rows that are later than that are dropped. A row is emitted once the watermark is past everything
    that it looks ahead to; a time-out does this for a station that falls silent. Equals ``time_lags`` and ``eligible`` on all rows.
    """
    ahead = longest_gap * (max(horizons) + 1)
    back = max(*lags, longest_gap * lookback)
    least = lookback + max(horizons) + 1
    names = [f"{column}_lag_{h}h" for h in lags], [f"y_h{h}" for h in horizons], [f"eligible_h{h}" for h in horizons]
    kinds = rows.schema
    out = StructType([kinds[k] for k in keys]).add(ts, "timestamp").add(column, "double")
    for n in (*names[0], *names[1]):
        out = out.add(n, "double")
    for n in names[2]:
        out = out.add(n, "boolean")
    state = StructType.fromDDL("times array<bigint>, values array<double>, done bigint, place bigint")

    def one(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        times, values, done, place = held.get if held.exists else ([], [], -(1 << 60), 0)
        known = dict(zip(times, values, strict=True))
        for f in frames:
            for t, v in sorted(zip(f["_t"].tolist(), f["_v"].tolist(), strict=True), key=lambda x: (x[0], x[1] != x[1], x[1])):
                known.setdefault(t, None if v != v else v)
        watermark = held.getCurrentWatermarkMs() // 1000
        order = sorted(known)
        # place of each row in its segment; ``place`` is that of the first row that is held
        places = []
        for i, t in enumerate(order):
            places.append(place if i == 0 and place else 1 if i == 0 or t - order[i - 1] > longest_gap * HOUR else places[-1] + 1)
        ends = [0] * len(order)
        for i in range(len(order) - 1, -1, -1):
            ends[i] = ends[i + 1] if i + 1 < len(order) and places[i + 1] > 1 else i
        found = []
        for i, t in enumerate(order):
            if t <= done or t + ahead * HOUR > watermark:
                continue
            whole = places[i] >= lookback and all(known[order[k]] is not None for k in range(i - lookback + 1, i + 1))
            room = ends[i] - i  # rows of the segment that follow
            y = [known.get(t + h * HOUR) for h in horizons]
            fits = [whole and places[i] + room >= least and room >= h and v is not None for h, v in zip(horizons, y, strict=True)]
            found.append((*key, pd.Timestamp(t, unit="s"), known[t], *(known.get(t - h * HOUR) for h in lags), *y, *fits))
            done = max(done, t)
        # rows that no open row reaches any more go
        keep = next((i for i, t in enumerate(order) if t > done - back * HOUR), len(order))
        kept = order[keep:]
        open_rows = [t for t in kept if t > done]
        if kept:
            held.update((kept, [known[t] for t in kept], done, places[keep]))
            if open_rows:
                held.setTimeoutTimestamp(max(open_rows[0] + ahead * HOUR, watermark + 1) * 1000)
        elif held.exists:
            held.remove()
        if found:
            yield pd.DataFrame(found, columns=out.names).astype({n: "float64" for n in (column, *names[0], *names[1])})

    source = rows.withWatermark(ts, late).select(*keys, ts, F.unix_timestamp(ts).alias("_t"), F.col(column).cast("double").alias("_v"))
    return source.groupBy(*keys).applyInPandasWithState(one, out, state, "append", GroupStateTimeout.EventTimeTimeout)
