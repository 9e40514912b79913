"""Lagged products of ordered values, for any number of columns and rows, in one sort.

Rows are dealt by ranges of their order, so a task holds a stretch of it whatever series that is made of. A task
adds up the products x(i) y(i - k) of all pairs of columns for every lag k within its stretch, as small matrices, and
passes on its first and last rows; the products across two stretches need no more. So neither a long
series nor many short ones meet in one task, and no lagged copy of a row is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most lags of the long-run variance.
MOST_LAGS = 10


class Stretch:
    """Sums of products of consecutive rows, their number, and the rows at both ends."""

    def __init__(self, width: int):
        self.n, self.products = 0, np.zeros((MOST_LAGS + 1, width, width))
        self.head = self.tail = np.zeros((0, width))

    def append(self, x: np.ndarray) -> None:
        """Rows that follow."""
        self._meet(x)
        for k in range(min(MOST_LAGS + 1, len(x))):
            self.products[k] += x[k:].T @ x[: len(x) - k]
        self._extend(len(x), x[:MOST_LAGS], x[-MOST_LAGS:])

    def join(self, other: Stretch) -> None:
        """A stretch that follows."""
        self._meet(other.head)
        self.products += other.products
        self._extend(other.n, other.head, other.tail)

    def _meet(self, head: np.ndarray) -> None:
        both, before = np.vstack([self.tail, head[:MOST_LAGS]]), len(self.tail)
        for k in range(1, MOST_LAGS + 1):
            later = np.arange(before, min(len(both), before + k))
            later = later[later >= k]
            self.products[k] += both[later].T @ both[later - k]

    def _extend(self, n: int, head: np.ndarray, tail: np.ndarray) -> None:
        if self.n < MOST_LAGS:
            self.head = np.vstack([self.head, head])[:MOST_LAGS]
        self.tail = np.vstack([self.tail, tail])[-MOST_LAGS:]
        self.n += n

    def packed(self) -> list[bytes]:
        return [self.products.tobytes(), self.head.tobytes(), self.tail.tobytes()]

    @classmethod
    def unpacked(cls, width: int, n: int, products: bytes, head: bytes, tail: bytes) -> Stretch:
        out = cls(width)
        out.n, out.products = n, np.frombuffer(products).reshape(MOST_LAGS + 1, width, width)
        out.head, out.tail = (np.frombuffer(x).reshape(-1, width) for x in (head, tail))
        return out


_PARTS = "part bigint, n bigint, products binary, head binary, tail binary"


def _stretches(values: DataFrame, order: list[str], by: str, columns: list[str]) -> DataFrame:
    """(by, part, ...): what each range of rows has of each group, about the columns' means in the group."""
    own = [f"_v{i}" for i in range(len(columns))]
    means = values.groupBy(by).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    centred = values.select(by, *order, *columns).join(means, by).select(by, *order, *[(F.col(c) - F.col(f"_m{i}")).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    kind = values.schema[by].dataType

    def run(batches) -> Iterator[pa.RecordBatch]:
        found: dict[object, Stretch] = {}
        schema = None
        for b in batches:
            schema = b.schema.field(by).type
            groups = b.column(by).to_pylist()
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in own])
            edges = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)] if groups else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                found.setdefault(groups[i], Stretch(len(own))).append(x[i:j])
        if found:
            part = TaskContext.get().partitionId()
            packs = list(zip(*(s.packed() for s in found.values()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), schema), pa.array([part] * len(found), pa.int64()), pa.array([s.n for s in found.values()], pa.int64()), *(pa.array(p, pa.binary()) for p in packs)], [by, "part", "n", "products", "head", "tail"])

    dealt = centred.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    return dealt.mapInArrow(run, f"`{by}` {kind.simpleString()}, {_PARTS}").join(means, by)


def _whole(t: pa.Table, width: int) -> Stretch:
    """A group's stretches in order, as one."""
    t = t.sort_by("part")
    out = Stretch(width)
    for n, *packs in zip(*(t.column(c).to_pylist() for c in ("n", "products", "head", "tail")), strict=True):
        out.join(Stretch.unpacked(width, n, *packs))
    return out


_P = ", ".join(f"p{k} double" for k in range(MOST_LAGS + 1))


def lagged_products(values: DataFrame, order: list[str], by: str = "horizon", value: str = "d") -> DataFrame:
    """by, n, mean and p0..p10: the sums of c(i) c(i - k) over a group's total order, c being the value less its mean.

    ``order`` is the series keys and then the time; values are not NULL.
    """

    def merge(t: pa.Table) -> pa.Table:
        s = _whole(t, 1)
        return pa.table({by: t.column(by).slice(0, 1), "n": [s.n], "mean": [t.column("_m0")[0].as_py()], **{f"p{k}": [float(s.products[k, 0, 0])] for k in range(MOST_LAGS + 1)}})

    kind = values.schema[by].dataType.simpleString()
    return _stretches(values, order, by, [value]).groupBy(by).applyInArrow(merge, f"`{by}` {kind}, n bigint, mean double, {_P}")


def pair_products(losses: DataFrame, order: list[str], columns: list[str], by: str = "horizon") -> DataFrame:
    """by, model1, model2, n, mean and p0..p10 of the difference of every pair of columns.

    The products of a difference are sums of four products of the columns, so one pass over the rows serves all pairs.
    """

    def merge(t: pa.Table) -> pa.Table:
        s = _whole(t, len(columns))
        means = [t.column(f"_m{i}")[0].as_py() for i in range(len(columns))]
        rows = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
        p = lambda k, i, j: float(s.products[k, i, i] - s.products[k, i, j] - s.products[k, j, i] + s.products[k, j, j])
        out = {by: [t.column(by)[0].as_py()] * len(rows), "model1": [columns[i] for i, _ in rows], "model2": [columns[j] for _, j in rows], "n": [s.n] * len(rows), "mean": [means[i] - means[j] for i, j in rows]}
        return pa.table({**out, **{f"p{k}": [p(k, i, j) for i, j in rows] for k in range(MOST_LAGS + 1)}}).cast(pa.schema([(by, t.schema.field(by).type), ("model1", pa.string()), ("model2", pa.string()), ("n", pa.int64()), ("mean", pa.float64()), *((f"p{k}", pa.float64()) for k in range(MOST_LAGS + 1))]))

    kind = losses.schema[by].dataType.simpleString()
    return _stretches(losses, order, by, columns).groupBy(by).applyInArrow(merge, f"`{by}` {kind}, model1 string, model2 string, n bigint, mean double, {_P}")
