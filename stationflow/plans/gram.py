"""Least squares from mergeable sums.

One pass over the rows adds up X'X, X'y and y'y (a few kB to MB) for every design, target and group; groups are
combinations of a few columns, such as a fold and a country. Everything else is arithmetic on these sums: a fold's
training side is the sum of its groups, a left-out country is subtracted, and every penalty and every horizon is
solved without another scan. Tasks add up their own rows and pass on one matrix a group; the matrices of
a group are added in two steps, so that no task reads those of all others.

A second pass predicts with any number of solutions at once. Rows with a null or NaN feature take no part in either.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts in which the matrices of a group are added first.
PARTS = 32


@dataclass(frozen=True)
class Linear:
    """The features and a constant."""

    features: tuple[str, ...]

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([rows, np.ones(len(rows))])

    def penalty(self, lam: float, sums: Gram) -> np.ndarray:
        """lam x n x variance on each weight, none on the constant: a ridge on standardised features."""
        n, total = max(sums.n, 1.0), sums.xx[-1, :-1]
        spread = np.diag(sums.xx)[:-1] - total * total / n
        return np.diag(np.append(lam * np.maximum(spread, 0.0), 0.0))


@dataclass(frozen=True)
class Splines:
    """One smooth per feature: B-splines on equal knots between ``ends``, with a penalty on second differences."""

    features: tuple[str, ...]
    ends: tuple[tuple[float, float], ...]
    n_splines: int = 20
    degree: int = 3

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        inner, out = self.n_splines - self.degree, []
        for c, (lo, hi) in enumerate(self.ends):
            step = max((hi - lo) / inner, 1e-9)
            place = (np.clip(rows[:, c], lo, lo + inner * step) - lo) / step
            whole = np.minimum(place.astype(np.int64), inner - 1)
            b = np.zeros((len(rows), self.n_splines + 1))
            b[np.arange(len(rows)), whole + self.degree] = 1.0
            for d in range(1, self.degree + 1):  # each spline from two of one degree less
                left = place[:, None] - (np.arange(self.n_splines) - self.degree)
                b = np.column_stack([(left * b[:, :-1] + (d + 1 - left) * b[:, 1:]) / d, np.zeros(len(rows))])
            out.append(b[:, :-1])
        return np.column_stack(out)

    def penalty(self, lam: float, sums: Gram) -> np.ndarray:
        second = np.diff(np.eye(self.n_splines), 2, axis=0)
        # the splines of a feature sum to 1, so they hold the constant; a slight ridge settles what several features share
        return lam * np.kron(np.eye(len(self.features)), second.T @ second) + 1e-11 * max(sums.n, 1.0) * np.eye(len(self.features) * self.n_splines)


Design = Linear | Splines


def splines(df: DataFrame, features: list[str], n_splines: int = 20) -> Splines:
    """Splines between the smallest and largest value of each feature."""
    found = df.agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{c}_{n}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return Splines(tuple(features), tuple((found[f"{c}_lo"] or 0.0, found[f"{c}_hi"] or 0.0) for c in features), n_splines)


@dataclass
class Gram:
    """Sums over rows: n, X'X, X'y and y'y."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def solve(self, design: Design, lam: float = 0.0) -> np.ndarray:
        """The weights of least penalised squares; the shortest ones where the rows leave some open."""
        a = self.xx + design.penalty(lam, self)
        size = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns to one size first, for accuracy
        return np.linalg.lstsq(a / size[:, None] / size, self.xy / size, rcond=1e-12)[0] / size

    def squared_error(self, weights: np.ndarray) -> float:
        """Mean squared error of these weights on the rows."""
        return float((self.yy - 2 * weights @ self.xy + weights @ self.xx @ weights) / max(self.n, 1.0))


@dataclass
class Sums:
    """Sums by (design, target, *group)."""

    found: dict[tuple, Gram] = field(default_factory=dict)

    def total(self, design: int, target: str, keep=lambda group: True) -> Gram | None:
        """Of the groups that ``keep`` (given the group's tuple) is true for."""
        out = None
        for (d, t, *group), g in self.found.items():
            if d == design and t == target and keep(tuple(group)):
                out = g if out is None else out + g
        return out


def _add(into: dict, key, value: Gram) -> None:
    into[key] = into[key] + value if key in into else value


def _columns(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if names else np.zeros((b.num_rows, 0))


def sums(df: DataFrame, designs: list[Design], targets: list[str], groups: tuple[str, ...] = ()) -> Sums:
    """The sums of every design, target and group, in one job. What comes to the driver is a matrix for each."""
    features = list(dict.fromkeys(c for d in designs for c in d.features))
    chosen = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])], *[F.col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(groups)])
    n_groups = len(groups)

    def packed(held: dict) -> pa.RecordBatch:
        keys = [pickle.dumps(k) for k in held]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([pickle.dumps(g) for g in held.values()], pa.binary())], ["key", "gram"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Gram] = {}
        for b in batches:
            labels = list(zip(*(b.column(f"_g{i}").to_pylist() for i in range(n_groups)), strict=True)) if n_groups else [()] * b.num_rows
            codes = {g: i for i, g in enumerate(dict.fromkeys(labels))}
            group = np.array([codes[g] for g in labels], np.int64)
            y = _columns(b, targets)
            for d, design in enumerate(designs):
                rows = _columns(b, list(design.features))
                whole = ~np.isnan(rows).any(1)
                x = design.matrix(np.where(np.isnan(rows), 0.0, rows))
                for g, code in codes.items():
                    for t, name in enumerate(targets):
                        at = whole & (group == code) & ~np.isnan(y[:, t])
                        if at.any():
                            a, v = x[at], y[at, t]
                            _add(held, (d, name, *g), Gram(float(len(a)), a.T @ a, a.T @ v, float(v @ v)))
        yield packed(held)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Gram] = {}
        for b in batches:
            for k, g in zip(b.column("key").to_pylist(), b.column("gram").to_pylist(), strict=True):
                _add(held, pickle.loads(k), pickle.loads(g))
        yield packed(held)

    schema = "key binary, gram binary"
    parts = chosen.mapInArrow(run, schema)
    dealt = parts.repartition(PARTS, "key", (F.rand(1) * PARTS).cast("int")).mapInArrow(merge, schema)
    whole = dealt.repartition(PARTS, "key").mapInArrow(merge, schema).toArrow()
    found: dict[tuple, Gram] = {}
    for k, g in zip(whole.column("key").to_pylist(), whole.column("gram").to_pylist(), strict=True):
        _add(found, pickle.loads(k), pickle.loads(g))
    return Sums(found)


def predict(df: DataFrame, models: dict[str, tuple[Design, np.ndarray]]) -> DataFrame:
    """A column of predictions for each named model, in one pass; NULL where a feature is NULL or NaN."""
    features = list(dict.fromkeys(c for d, _ in models.values() for c in d.features))
    own = [f"_f{i}" for i in range(len(features))]
    place = {c: i for i, c in enumerate(own)}
    schema = df.schema
    for m in models:
        schema = schema.add(m, "double")

    def run(batches):
        for b in batches:
            kept = [b.column(c) for c in b.schema.names if c not in place]
            rows, new, made = _columns(b, own), [], {}
            for design, weights in models.values():
                if design not in made:
                    x = rows[:, [features.index(c) for c in design.features]]
                    bad = np.isnan(x).any(1)
                    made[design] = design.matrix(np.where(np.isnan(x), 0.0, x)), bad
                x, bad = made[design]
                new.append(pa.array(x @ weights, mask=bad))
            yield pa.RecordBatch.from_arrays([*kept, *new], [*(c for c in b.schema.names if c not in place), *models])

    return df.select("*", *[F.col(c).cast("double").alias(n) for c, n in zip(features, own, strict=True)]).mapInArrow(run, schema)


def absolute_errors(df: DataFrame, models: dict[str, tuple[Design, np.ndarray]], label: dict[str, str], rows: dict[str, object]) -> dict[str, float]:
    """Mean absolute error of each model against its label on its own rows (a condition), in one aggregation."""
    scored = predict(df, models)
    found = scored.agg(*[F.avg(F.when(rows[m], F.abs(F.col(m) - F.col(label[m])))).alias(m) for m in models]).first()
    return {m: float(found[m]) if found[m] is not None else float("inf") for m in models}
