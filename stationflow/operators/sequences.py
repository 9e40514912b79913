"""Training sequences, packed: each row is stored once, and windows are cut when they are read.

``pack`` stores one matrix of 32-bit floats for each part of a station (see ``timeseries``) with the few rows
before it that its first windows need, and the places of the rows that can anchor a window. ``read_windows`` is a
table function beside it: it yields one window an anchor and horizon. Copying every row into each window it is in
would multiply the table by the lookback.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import PART, STATION, eligible, with_halo

_SCHEMA = "n_rows int, n_features int, times binary, features binary, targets binary, persistence binary, anchors array<array<int>>"


def pack(df: DataFrame, features: list[str], target: str, horizons: list[int], lookback: int, longest_gap: float = 2, keep: Column | None = None, keys=STATION, ts: str = "ts", extra: tuple[str, ...] = (), persistence: str | None = None) -> DataFrame:
    """(keys, part, n_rows, n_features, times, features, targets, persistence, anchors) of every part with an anchor.

    ``features`` are stored as they are (scale them before), in order; ``target`` gives the value of each
    horizon, ``persistence`` (the target itself unless named) the forecast by the value now, both as doubles. ``anchors`` has for each
    horizon the rows that have ``lookback`` complete rows in their segment and a target; ``keep`` leaves out more. ``extra`` columns are one value a station.
    """
    now = persistence or target
    ready = eligible(df.withColumns({"_target": F.col(target), "_now": F.col(now)}), features, "_target", horizons, lookback, longest_gap, keys, ts)
    wanted = keep if keep is not None else F.lit(True)
    marks = F.array(*[F.coalesce(F.col(f"eligible_h{h}") & wanted, F.lit(False)) for h in horizons])
    rows, own = with_halo(ready.withColumn("_marks", marks), int(np.ceil(longest_gap * (lookback - 1))), 0, ts)
    names = [f"_x{i}" for i in range(len(features))]
    rows = rows.select(*keys, *extra, PART, F.unix_micros(F.col(ts).cast("timestamp")).alias("_time"), own.alias("_own"), "_marks", F.col("_now").cast("double").alias("_now"),
        *[F.col(f"y_h{h}").cast("double").alias(f"_y{h}") for h in horizons], *[F.col(c).cast("float").alias(n) for c, n in zip(features, names, strict=True)])
    held = [*keys, *extra, PART]
    types = dict(rows.dtypes)

    def one(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("_time")
        own_rows = group["_own"].to_numpy().astype(bool)
        marks = np.array(group["_marks"].to_pylist(), bool).reshape(len(own_rows), len(horizons)) & own_rows[:, None]
        first = {c: group[c].slice(0, 1).combine_chunks() for c in held}
        empty = pa.table({c: v.slice(0, 0) for c, v in first.items()} | {c: pa.array([], t) for c, t in zip(_NAMES, _TYPES, strict=True)})
        if not marks.any():
            return empty
        start = max(0, int(np.flatnonzero(marks.any(1))[0]) - lookback + 1)
        number = lambda c, t: np.array([np.nan if v is None else v for v in group[c].to_pylist()], t)[start:]
        x = np.column_stack([number(c, np.float32) for c in names]).astype("<f4")
        y = np.column_stack([number(f"_y{h}", np.float64) for h in horizons]).astype("<f8")
        values = [len(x), len(names), group["_time"].to_numpy()[start:].astype("<i8").tobytes(), x.tobytes(), y.tobytes(), number("_now", np.float64).astype("<f8").tobytes(), [np.flatnonzero(m).tolist() for m in marks[start:].T]]
        return pa.table({c: v for c, v in first.items()} | {c: pa.array([v], t) for c, t, v in zip(_NAMES, _TYPES, values, strict=True)})

    schema = ", ".join(f"`{c}` {types[c]}" for c in held)
    return rows.groupBy(*keys, PART).applyInArrow(one, f"{schema}, {_SCHEMA}").withColumnRenamed(PART, "part")


_NAMES = [x.split()[0] for x in "n_rows int, n_features int, times binary, features binary, targets binary, persistence binary, anchors array".split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int32()))]


class _Windows:
    """Cuts the windows of one packed part."""

    def eval(self, n_rows: int, n_features: int, times: bytes, features: bytes, targets: bytes, persistence: bytes, anchors: list, horizons: list, lookback: int):
        x = np.frombuffer(features, "<f4").reshape(n_rows, n_features)
        y, t, now = np.frombuffer(targets, "<f8").reshape(n_rows, len(horizons)), np.frombuffer(times, "<i8"), np.frombuffer(persistence, "<f8")
        for k, (h, rows) in enumerate(zip(horizons, anchors, strict=True)):
            for i in rows:
                yield int(t[i]), int(h), x[i - lookback + 1 : i + 1].ravel().tolist(), float(y[i, k]), float(now[i])


def read_windows(packed: DataFrame, horizons: list[int], lookback: int, keys=STATION, extra: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(keys, extra, ts, horizon, sequence, y_true, y_persistence): one row an anchor and horizon; the sequence is row by row, features in order."""
    windows = F.udtf(_Windows, returnType="at bigint, horizon int, sequence array<float>, y_true double, y_persistence double")
    args = [F.col(c).outer() for c in _NAMES]
    cut = packed.lateralJoin(windows(*args, F.array(*map(F.lit, horizons)), F.lit(lookback)))
    return cut.select(*keys, *extra, F.timestamp_micros("at").alias(ts), "horizon", "sequence", "y_true", "y_persistence")
