"""Sorts, limits and reproducible samples.

Rows by rank are found by thresholds and not by a sort: counts by day, by time within the day of the
cut and by key at the time of the cut give the row at a rank, and one comparison then takes all rows up to it.
No plan here moves its rows to one partition; what passes through the driver is a count a day, a time of one day
and a first key at one time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at_rank(counts: list[tuple], n: int) -> tuple:
    """(value, rows before it) of the group that holds the n-th row, the groups being in order."""
    before = 0
    for value, c in counts:
        if before + c >= n:
            return value, before
        before += c
    raise ValueError("there are fewer rows")


def _counts(df: DataFrame, value: Column, descending: bool = False) -> list[tuple]:
    found = df.groupBy(value.alias("v")).count().collect()
    return sorted(((r[0], r[1]) for r in found), key=lambda x: x[0], reverse=descending)


def row_at_rank(df: DataFrame, n: int, ts: str, keys: list[str], descending: bool = False, days: list[tuple] | None = None) -> tuple:
    """((time, *keys) of the n-th row by time and then keys, rows before its repeats). Times and keys are not NULL."""
    day, before = _at_rank(days if days is not None else _counts(df, F.to_date(ts), descending), n)
    here = df.where(F.to_date(ts) == F.lit(day))
    seconds, more = _at_rank(_counts(here, F.unix_micros(F.col(ts).cast("timestamp")), descending), n - before)
    before, values = before + more, [F.timestamp_micros(F.lit(seconds))]
    here = here.where(F.col(ts) == values[0])
    for i, k in enumerate(keys):
        if i == len(keys) - 1:
            # of one time and the keys before it
            value = here.select(k).orderBy(k).offset(n - before - 1).limit(1).first()[0]
            before += here.where(F.col(k) < F.lit(value)).count()
        else:
            value, more = _at_rank(_counts(here, F.col(k)), n - before)
            before += more
        values.append(F.lit(value))
        here = here.where(F.col(k) == values[-1])
    return tuple(values), before


def up_to(row: tuple, ts: str, keys: list[str], descending: bool = False, strict: bool = False) -> Column:
    """The rows up to (or, strict, before) a row, by time and then keys."""
    columns = [F.col(ts), *map(F.col, keys)]
    found = F.lit(not strict)
    for i in range(len(columns) - 1, -1, -1):
        earlier = columns[i] > row[i] if i == 0 and descending else columns[i] < row[i]
        found = earlier | ((columns[i] == row[i]) & found)
    return found


def last_rows(df: DataFrame, n: int, ts: str, keys: list[str]) -> DataFrame:
    """The n latest rows; keys break ties. Rows without a time or key come last and are taken by a sort of their own, if at all."""
    whole = df.where(F.col(ts).isNotNull() & _all_there(keys))
    days = _counts(whole, F.to_date(ts), True)
    n_whole = sum(c for _, c in days)
    if n <= 0:
        return df.limit(0)
    if n_whole < n:
        rest = df.where(F.col(ts).isNull() | ~_all_there(keys))
        return whole.unionByName(rest.orderBy(F.col(ts).desc(), *keys).limit(n - n_whole))
    row, before = row_at_rank(whole, n, ts, keys, True, days)
    same = F.lit(True)
    for c, v in zip([ts, *keys], row, strict=True):
        same = same & (F.col(c) == v)
    if n - before < whole.where(same).limit(n - before + 1).count():  # repeats of the last row: only so many of them
        return whole.where(up_to(row, ts, keys, True, strict=True)).unionByName(whole.where(same).limit(n - before))
    return whole.where(up_to(row, ts, keys, True))


def _all_there(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def row_folds(df: DataFrame, n: int, ts: str, keys: list[str]) -> tuple[DataFrame, list[int]]:
    """Rows with ``fold`` 0..n in row order (time, then keys), and the folds' sizes: expanding fold i trains on those up to i and validates on i + 1.

    As many equal test folds as asked for at the end; what is left over goes to the first part.
    """
    days = _counts(df, F.to_date(ts))
    total = sum(c for _, c in days)
    size = total // (n + 1)
    if not size:
        raise ValueError(f"{total} rows are too few for {n} folds")
    starts = [total - (n - i) * size for i in range(n)]
    fold = F.lit(0)
    for s in starts:
        fold = fold + (~up_to(row_at_rank(df, s, ts, keys, False, days)[0], ts, keys)).cast("int")
    return df.withColumn("fold", fold), [starts[0], *[size] * n]


#: Hexadecimal digits of the hash that are counted at once.
DIGITS = 4


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), chosen by a hash of their keys' texts that any engine has.

    Counts by the hash's first digits, and by the next ones at the cut, leave a handful of rows to be sorted.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    x = df.withColumn("_hash", F.md5(text.cast("binary")))
    here, taken, prefix = x, F.lit(False), ""
    left = n
    for _ in range(2):
        counts = _counts(here, F.substring("_hash", len(prefix) + 1, DIGITS))
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        if n <= 0:
            return df.limit(0)
        digits, before = _at_rank(counts, left)
        prefix, left = prefix + digits, left - before
        taken = F.substring("_hash", 1, len(prefix)) < prefix
        here = x.where(F.substring("_hash", 1, len(prefix)) == prefix)
    return x.where(taken).unionByName(here.orderBy("_hash", *keys).limit(left)).drop("_hash")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_then_sample(df: DataFrame, first: int, n: int, order: list[str], seed: int = 42) -> DataFrame:
    return seeded_sample(df.orderBy(*order).limit(first), n, order, seed)


def first_per_group(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top(df: DataFrame, n: int, by: str, keys: list[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *keys).limit(n)
