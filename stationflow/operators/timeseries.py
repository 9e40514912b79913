"""Window operators over keyed series with gaps, for series of any length.

No window is keyed by a station alone: a series is cut into parts of ``SPAN`` hours, so its rows are dealt to
many tasks.

* Operators with a bounded reach (lags, targets, rolling values) give each part a halo: rows that lie within
  reach of a part are copied to it, and dropped once the windows have run. Time frames are RANGE frames in
  seconds: a gap gives NULL, and no hourly grid is built.
* Operators with an unbounded reach (gaps, segments, positions, gap filling) are scans of two levels: windows
  within each part, a summary row a part, a running value over a station's summaries, and a join that hands each
  part what the earlier and later ones leave to it. The second level has one row for ``SPAN`` hours.

Any mix of bounded operators shares one exchange and one sort through ``in_slices``.

Precondition: a station has one row a time (``first_per_key`` makes it so); of repeated rows an arbitrary one
is the lag, and each counts in positions. Rows without a key or a time belong to no series: bounded operators
keep them, scans drop them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
STATION = ("country", "site_number")
#: Hours of a station in one part; a part is longer where the reach of an operator asks for it.
SPAN = 4096
PART = "_part"


def epoch(ts: str = "ts") -> Column:
    return F.unix_timestamp(F.col(ts))


def by_station(keys=STATION, ts: str = "ts"):
    return Window.partitionBy(*keys).orderBy(epoch(ts))


def _part_of(seconds: Column, hours: int) -> Column:
    return F.floor(seconds / (hours * HOUR))


def in_slices(df: DataFrame, build: Callable[[DataFrame, tuple], DataFrame], back: int = 0, ahead: int = 0, keys=STATION, ts: str = "ts", keep_part: bool = False) -> DataFrame:
    """``build(rows, keys)`` over parts of each series that know ``back`` hours before and ``ahead`` hours after them."""
    x, own_rows = with_halo(df, back, ahead, ts)
    own = build(x, (*keys, PART)).where(own_rows)
    return own if keep_part else own.drop(PART)


def with_halo(df: DataFrame, back: int, ahead: int, ts: str = "ts") -> tuple[DataFrame, Column]:
    """The rows of each part and those within reach of it, and the condition that tells a part's own rows."""
    hours = max(SPAN, 8 * (back + ahead))
    reached = F.sequence(_part_of(epoch(ts) - ahead * HOUR, hours), _part_of(epoch(ts) + back * HOUR, hours))
    return df.select("*", F.explode_outer(reached).alias(PART)), F.col(PART).eqNullSafe(_part_of(epoch(ts), hours))


def at_offset(column: str, hours: int, keys=STATION, ts: str = "ts") -> Column:
    """The value exactly ``hours`` later (earlier if negative) among the rows of ``keys``; NULL if there is no such row."""
    return F.last(column).over(by_station(keys, ts).rangeBetween(hours * HOUR, hours * HOUR))


def lag_columns(columns: list[str], hours: list[int], keys, ts: str = "ts") -> dict[str, Column]:
    return {f"{c}_lag_{h}h": at_offset(c, -h, keys, ts) for c in columns for h in hours}


def rolling_columns(columns: list[str], hours: list[int], keys, ts: str = "ts", std: bool = True) -> dict[str, Column]:
    new = {}
    for c in columns:
        for h in hours:
            frame = by_station(keys, ts).rangeBetween(-(h - 1) * HOUR, 0)
            new[f"{c}_rolling_mean_{h}h"] = F.avg(c).over(frame)
            if std:
                new[f"{c}_rolling_std_{h}h"] = F.stddev_samp(c).over(frame)
    return new


def target_columns(column: str, horizons: list[int], keys, ts: str = "ts") -> dict[str, Column]:
    return {f"y_h{h}": at_offset(column, h, keys, ts) for h in horizons}


def time_lags(df: DataFrame, columns: list[str], hours: list[int], keys=STATION, ts: str = "ts") -> DataFrame:
    return in_slices(df, lambda x, k: x.withColumns(lag_columns(columns, hours, k, ts)), max(hours), 0, keys, ts)


def rolling(df: DataFrame, columns: list[str], hours: list[int], keys=STATION, ts: str = "ts", std: bool = True) -> DataFrame:
    """Mean (and sample deviation) over the last n hours, this one included, of the values there are."""
    return in_slices(df, lambda x, k: x.withColumns(rolling_columns(columns, hours, k, ts, std)), max(hours) - 1, 0, keys, ts)


def targets(df: DataFrame, column: str, horizons: list[int], keys=STATION, ts: str = "ts") -> DataFrame:
    """y_h{h}: the value h hours later."""
    return in_slices(df, lambda x, k: x.withColumns(target_columns(column, horizons, k, ts)), 0, max(horizons), keys, ts)


# --- scans of two levels -------------------------------------------------------------------------


def _cut(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(PART, _part_of(epoch(ts), SPAN))


def _running(keys, ts: str):
    return by_station(keys, ts).rowsBetween(Window.unboundedPreceding, 0)


def _backwards(keys, order: Column):
    """Everything after a row: a running frame from the end, where an unbounded following one would start anew at every row."""
    return Window.partitionBy(*keys).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -1)


def handed_over(x: DataFrame, keys, summary: dict[str, Column], earlier: dict[str, Column], later: dict[str, Column] | None = None, *, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows with what the other parts of their series leave to their part.

    ``summary`` aggregates a part. ``earlier`` and ``later`` are aggregates of the summaries of the parts before
    and after; ``more`` sees both, and its aggregates run over the parts before (names that end in ``_after``: over those after).
    ``_rows_before``, the rows of the parts before, is always there.
    """
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    after = _backwards(keys, F.col(PART))
    per = x.groupBy(*keys, PART).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in summary.items()])
    per = per.withColumns({"_rows_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), **{n: c.over(before) for n, c in earlier.items()}, **{n: c.over(after) for n, c in (later or {}).items()}})
    if more:
        per = per.withColumns({n: c.over(after if n.endswith("_after") else before) for n, c in more.items()})
    return x.join(per.select(*keys, PART, "_rows_before", *earlier, *(later or {}), *(more or {})), [*keys, PART])


def gaps(df: DataFrame, keys=STATION, ts: str = "ts") -> DataFrame:
    """gap_hours since the station's previous row; NULL in its first."""
    x = _cut(df, ts).withColumn("_previous", F.lag(epoch(ts)).over(by_station((*keys, PART), ts)))
    x = handed_over(x, keys, {"_last": F.max(epoch(ts))}, {"_last_before": F.max("_last")})
    return x.withColumn("gap_hours", (epoch(ts) - F.coalesce("_previous", "_last_before")) / HOUR).select(*df.columns, "gap_hours")


def segments(df: DataFrame, longest_gap: float = 2, keys=STATION, ts: str = "ts", features: list[str] | None = None, lookback: int = 0) -> DataFrame:
    """segment_id counts from 0 and rises where a gap exceeds ``longest_gap`` hours; segment_pos from 1 and segment_len.

    With ``features`` also lookback_ok: none of them is NULL in the segment's last ``lookback`` rows.
    """
    part = (*keys, PART)

    def marked(x: DataFrame, k) -> DataFrame:
        return x.withColumn("_opens", F.coalesce(epoch(ts) - F.lag(epoch(ts)).over(by_station(k, ts)) > longest_gap * HOUR, F.lit(True)))

    # a series' first row opens a segment too, so all that is needed of the part before is its last hours
    x = in_slices(df, marked, math.ceil(longest_gap), 0, keys, ts, keep_part=True)
    x = x.withColumn("_row", F.row_number().over(by_station(part, ts)))
    missing = F.lit(False)
    for c in features or ():
        missing = missing | F.col(c).isNull()
    x = x.withColumns({"_opened": F.when(F.col("_opens"), F.col("_row")), "_lacks": F.when(missing, F.col("_row"))})
    x = x.withColumns({
        "_count": F.count("_opened").over(_running(part, ts)), "_start": F.max("_opened").over(_running(part, ts)),
        "_lacked": F.max("_lacks").over(_running(part, ts)), "_next": F.min("_opened").over(_backwards(part, F.col("_row"))),
    })
    ends = {"_n": F.count("_opened"), "_first_opened": F.min("_opened"), "_last_opened": F.max("_opened"), "_last_lacked": F.max("_lacks")}
    x = handed_over(
        x, keys, ends, {"_count_before": F.sum("_n")}, {"_rows_after": F.sum("_rows")},
        more={"_start_before": F.max(F.col("_rows_before") + F.col("_last_opened")), "_lacked_before": F.max(F.col("_rows_before") + F.col("_last_lacked")), "_next_after": F.min(F.col("_rows_before") + F.col("_first_opened"))},
    )
    before, row = F.col("_rows_before"), F.col("_rows_before") + F.col("_row")
    start = F.coalesce(before + F.col("_start"), F.col("_start_before"))
    total = before + F.coalesce("_rows_after", F.lit(0)) + F.count("*").over(Window.partitionBy(*part))
    end = F.coalesce(before + F.col("_next"), F.col("_next_after"), total + 1)
    new = {"segment_id": F.coalesce("_count_before", F.lit(0)) + F.col("_count") - 1, "segment_pos": row - start + 1, "segment_len": end - start}
    if features:
        new["lookback_ok"] = F.coalesce(F.greatest(before + F.col("_lacked"), "_lacked_before"), F.lit(0)) < F.greatest(row - lookback + 1, start)
    return x.withColumns(new).select(*df.columns, *new)


def eligible(df: DataFrame, features: list[str], target: str, horizons: list[int], lookback: int, longest_gap: float = 2, keys=STATION, ts: str = "ts") -> DataFrame:
    """eligible_h{h}: the row can anchor a sequence of ``lookback`` rows with a target h rows on.

    Run on a window that is already clipped, since clipping changes segments.
    """
    least = lookback + max(horizons) + 1
    x = segments(targets(df, target, horizons, keys, ts), longest_gap, keys, ts, features, lookback)
    base = (F.col("segment_len") >= least) & (F.col("segment_pos") >= lookback) & F.col("lookback_ok")
    return x.withColumns({f"eligible_h{h}": base & (F.col("segment_pos") <= F.col("segment_len") - h) & F.col(f"y_h{h}").isNotNull() for h in horizons})


def common_stations(df: DataFrame, train_end: str, test_start: str, test_end: str, features: list[str], keys=STATION, ts: str = "ts") -> DataFrame:
    """Stations with rows on both sides and at least one complete training row."""
    train, test = F.col(ts) <= F.lit(train_end).cast("timestamp"), F.col(ts).between(F.lit(test_start).cast("timestamp"), F.lit(test_end).cast("timestamp"))
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    found = df.groupBy(*keys).agg(F.max(train).alias("a"), F.max(test).alias("b"), F.max(train & whole).alias("c"))
    return found.where("a AND b AND c").select(*keys)


def anchors(df: DataFrame, features: list[str], target: str, horizons: list[int], lookback: int, train_end: str, test_start: str, test_end: str, longest_gap: float = 2, keys=STATION, ts: str = "ts") -> DataFrame:
    """(station, ts, side, horizon) of every eligible anchor of both sides; the test side warms up on earlier rows."""
    both = df.join(common_stations(df, train_end, test_start, test_end, features, keys, ts), list(keys), "left_semi")
    aimed = targets(both, target, horizons, keys, ts)
    names = [f"y_h{h}" for h in horizons]
    start = F.lit(test_start).cast("timestamp")
    parts = []
    for side, window, keep in (
        ("train", F.col(ts) <= F.lit(train_end).cast("timestamp"), F.lit(True)),
        ("test", F.col(ts).between(start - F.expr(f"INTERVAL {lookback - 1} HOURS"), F.lit(test_end).cast("timestamp")), F.col(ts) >= start),
    ):
        clipped = segments(aimed.where(window), longest_gap, keys, ts, features, lookback)
        least = lookback + max(horizons) + 1
        ready = clipped.where((F.col("segment_len") >= least) & (F.col("segment_pos") >= lookback) & F.col("lookback_ok") & keep)
        long = ready.select(*keys, ts, "segment_pos", "segment_len", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(y).alias("y")) for h, y in zip(horizons, names, strict=True)])).alias("t"))
        parts.append(long.where((F.col("segment_pos") <= F.col("segment_len") - F.col("t.horizon")) & F.col("t.y").isNotNull()).select(*keys, ts, F.lit(side).alias("side"), F.col("t.horizon").alias("horizon")))
    return parts[0].unionByName(parts[1])


def sequences(df: DataFrame, features: list[str], rows: int, keep: Column, keys=STATION, ts: str = "ts") -> DataFrame:
    """The last ``rows`` rows' features as ``sequence`` (array of arrays of float), for the anchors only."""
    w = Window.partitionBy(*keys, "segment_id").orderBy(epoch(ts)).rowsBetween(-(rows - 1), 0)
    return df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("float") for c in features])).over(w)).where(keep & (F.size("sequence") == rows))


def fill_gaps(df: DataFrame, columns: list[str], keys=STATION, ts: str = "ts", method: str = "row") -> DataFrame:
    """Linear interpolation between the nearest values by row position (or by time), edges by the nearest value.

    A station without any value stays NULL. Within a part both neighbours are running values; a part whose first
    or last rows lack a value gets the nearest one of the parts before or after.
    """
    part = (*keys, PART)
    x = _cut(df, ts).withColumn("_row", F.row_number().over(by_station(part, ts)))
    x = x.withColumn("_place", F.col("_row") if method == "row" else epoch(ts))
    # places and values apart, as plain numbers: structs would be copied row by row, and aggregated by a sort
    seen = {c: F.when(F.col(c).isNotNull(), F.col("_place").cast("long")) for c in columns}
    near = {}
    for c in columns:
        for e, frame in ((0, _running(part, ts)), (1, _backwards(part, F.col("_row")))):
            near[f"_{c}_p{e}"], near[f"_{c}_v{e}"] = F.last(seen[c], True).over(frame), F.last(c, True).over(frame)
    x = x.withColumns(near)
    before = F.col("_rows_before") if method == "row" else F.lit(0)
    ends = {n: a for c in columns for n, a in ((f"_{c}_p_first", F.min(seen[c])), (f"_{c}_v_first", F.min_by(c, seen[c])), (f"_{c}_p_last", F.max(seen[c])), (f"_{c}_v_last", F.max_by(c, seen[c])))}
    shifted = lambda k, name: before + F.col(name) if k == "p" else F.col(name)
    more = {f"_{c}_{k}_{name}": F.last(shifted(k, f"_{c}_{k}_{e}"), True) for c in columns for k in "pv" for name, e in (("before", "last"), ("after", "first"))}
    x = handed_over(x, keys, ends, {}, more=more)
    place, new = before + F.col("_place"), {}
    for c in columns:
        (ap, bp), (av, bv) = ([F.coalesce(shifted(k, f"_{c}_{k}{e}"), F.col(f"_{c}_{k}_{name}")) for e, name in ((0, "before"), (1, "after"))] for k in "pv")
        new[c] = F.coalesce(F.col(c), av + (bv - av) * (place - ap) / (bp - ap), av, bv)
    return x.withColumns(new).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def persistence(df: DataFrame, column: str, horizons: list[int], keys=STATION, ts: str = "ts", extra: tuple[str, ...] = ()) -> DataFrame:
    """The value now as forecast for h hours on, one row per horizon; incomplete pairs go."""
    aimed = targets(df, column, horizons, keys, ts)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_h{h}").alias("y_true")) for h in horizons])
    long = aimed.select(*keys, *extra, ts, F.col(column).alias("y_pred"), F.explode(pairs).alias("t"))
    return long.select(*keys, *extra, ts, "t.horizon", "t.y_true", "y_pred").where("y_true IS NOT NULL AND y_pred IS NOT NULL")


def densify(df: DataFrame, keys=STATION, ts: str = "ts") -> DataFrame:
    """Every hour from a station's first to its last row; new rows are NULL elsewhere."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias(ts))
    return grid.join(df, [*keys, ts], "left")
