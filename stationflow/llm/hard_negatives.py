"""Hard-negative mining by a secondary sort.

Every anchor is scored against every row by the exact integer inner product of the quantised vectors.
What a task has found is packed into keys (anchor, descending score, kind, id) whose bytes sort in that
order; rows are dealt by anchor and sorted within their partitions (``repartition`` and
``sortWithinPartitions``, the DataFrame form of ``repartitionAndSortWithinPartitions``), and an iterator
reads an anchor's keys from its highest score down: a positive opens a window of scores below it, a
negative goes to the windows that are open at its score. The iterator holds an anchor's few windows and
never its rows.

Before the shuffle each task reduces what it has scored: an anchor's best positives first, and, once
these are known, the first negatives of each of its windows. So an anchor sends a few keys a task and
not one a pair, however many rows share its label or its vector. Anchors are taken in blocks of at most
``BLOCK`` anchors and about ``BLOCK_BYTES``; only one block is at the driver and broadcast at a time. Rows
are read in as many stripes as twice the cluster's cores, so that the keys do not grow with the files.

Defined results: a row without vec_id, label or vector, or with a null or non-finite component, takes no
part; vectors of different lengths meet in the components that both have; of rows that share a vec_id,
those with the same score against an anchor and on the same side of its label count once, and the one
with the smallest (label, vector) is the anchor; ties go to the smaller vec_id; an anchor without
positives, and an empty table, give no rows; extra columns are ignored. Scores must fit in 64 bits, or
the task raises an error: they are exact, by doubles below 2^53 and by whole numbers of any size above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Anchors and bytes of vectors that are broadcast at once.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Pairs that a task scores at once.
CELLS = 1 << 20
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_KEY = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ident: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, descending score, kind and id."""
    keys = np.empty(len(anchor), _KEY)
    biased = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ _SIGN
    keys["anchor"], keys["down"], keys["kind"], keys["id"] = biased(anchor), ~biased(score), kind, biased(ident)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, kind, id) of packed keys."""
    keys = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    back = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return back(keys["anchor"]), back(~keys["down"].astype(np.uint64)), keys["kind"], back(keys["id"])


def vectors(b: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, label, whole-numbered components as doubles) of the rows of (vec_id, label, embedding) that take part."""
    there = pc.and_(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()), b.column(2).is_valid())
    b = b.filter(there)
    ids, labels, lists = b.column(0).cast(pa.int64()).to_numpy(), b.column(1).cast(pa.int64()).to_numpy(), b.column(2)
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls read as NaN
    of = np.repeat(np.arange(len(ids)), sizes)
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    finite = np.isfinite(values)
    out[of, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * np.where(finite, values, 0.0))
    whole = np.bincount(of[~finite], minlength=len(ids)) == 0
    return ids[whole], labels[whole], out[whole]


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact products of whole-numbered vectors, rows x anchors."""
    n = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :n], anchors[:, :n]
    if np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, n) < 2.0**53:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(rows) @ whole(anchors).T).astype(np.int64)  # raises beyond 64 bits


class Block:
    """Some anchors, by label, and their windows once their positives are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.low = self.high = np.zeros((len(ids), 0), np.int64)

    def open(self, positives: list[tuple[int, int]], low: int, high: int) -> None:
        """Windows of negatives' scores from (anchor, positive's score), in per cent of that score."""
        at = {a: i for i, a in enumerate(self.ids.tolist())}
        of: list[list[int]] = [[] for _ in at]
        for a, score in positives:
            of[at[a]].append(score)
        most = max(map(len, of), default=0)
        self.low, self.high = np.full((len(at), most), 1, np.int64), np.full((len(at), most), 0, np.int64)
        for i, scores in enumerate(of):
            for j, s in enumerate(scores):
                self.low[i, j], self.high[i, j] = -(-low * s // 100), high * s // 100


class Best:
    """The first n different (score, id) of each group, by descending score and ascending id."""

    def __init__(self, groups: int, n: int):
        self.n = n
        self.group = self.score = self.ident = np.zeros(0, np.int64)
        self.least = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Adds candidates; those under a group's ``least`` cannot be among its first."""
        if not len(group):
            return
        g, s, i = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ident, ident)))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
        g, s, i = g[fresh], s[fresh], i[fresh]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        self.least[g[rank == self.n - 1]] = s[rank == self.n - 1]
        keep = rank < self.n
        self.group, self.score, self.ident = g[keep], s[keep], i[keep]


def _slices(batches: Iterator[pa.RecordBatch], scale: int, n_anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, n_anchors))
    for b in batches:
        ids, labels, rows = vectors(b, scale)
        for i in range(0, len(ids), step):
            yield ids[i : i + step], labels[i : i + step], rows[i : i + step]


def score_positives(batches, block: Block, scale: int, n: int) -> Iterator[pa.RecordBatch]:
    """Keys of the first n rows of the same label that a task has, for every anchor."""
    best = Best(len(block.ids), n)
    for ids, labels, rows in _slices(batches, scale, len(block.ids)):
        for label in np.unique(labels).tolist():
            a, b = np.searchsorted(block.labels, [label, label + 1])
            if a == b:
                continue
            own = labels == label
            found = inner_products(rows[own], block.vectors[a:b])
            keep = (found >= best.least[a:b]) & (ids[own][:, None] != block.ids[a:b])
            r, c = np.nonzero(keep)
            best.add(c + a, found[r, c], ids[own][r])
    anchors = block.ids[best.group]
    yield pa.RecordBatch.from_arrays([pa.array(anchors), pack(anchors, best.score, POSITIVE, best.ident)], ["anchor", "key"])


def score_negatives(batches, block: Block, scale: int, n: int) -> Iterator[pa.RecordBatch]:
    """Keys of the first n rows of another label that a task has, for every window of every anchor."""
    windows = block.low.shape[1]
    best = Best(len(block.ids) * windows, n)
    for ids, labels, rows in _slices(batches, scale, len(block.ids)) if windows else ():
        found, other = inner_products(rows, block.vectors), labels[:, None] != block.labels
        for j in range(windows):
            least = np.maximum(block.low[:, j], best.least[j::windows])
            r, c = np.nonzero((found <= block.high[:, j]) & (found >= least) & other)
            best.add(c * windows + j, found[r, c], ids[r])
    # a row that several windows of an anchor want is sent once
    each = np.unique(np.stack([block.ids[best.group // max(1, windows)], best.score, best.ident]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(each[0]), pack(each[0], each[1], NEGATIVE, each[2])], ["anchor", "key"])


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartition("anchor").sortWithinPartitions("key")


def first_positives(batches, n: int) -> Iterator[pa.RecordBatch]:
    """The first n different positives of each anchor, from sorted keys."""
    anchor, seen, last = None, 0, None
    for b in batches:
        keep = []
        for k, (a, s, i) in enumerate(zip(*(x.tolist() for j, x in enumerate(unpack(b.column(1))) if j != 2), strict=True)):
            if a != anchor:
                anchor, seen, last = a, 0, None
            if seen < n and (s, i) != last:
                keep.append(k)
                seen, last = seen + 1, (s, i)
        yield b.take(pa.array(keep, pa.int64()))


def emit_negatives(batches, n: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """An anchor's windows and the first n negatives in each, from sorted keys."""
    anchor, last = None, None
    windows: list[list[int]] = []  # positive, its score, negatives so far
    for b in batches:
        out: list[tuple[int, int, int, int, int, int]] = []
        for a, s, kind, i in zip(*(x.tolist() for x in unpack(b.column(1))), strict=True):
            if a != anchor:
                anchor, last, windows = a, None, []
            if (s, kind, i) == last:
                continue
            last = s, kind, i
            if kind == POSITIVE:
                windows.append([i, s, 0])
                continue
            for w in windows:
                if w[2] < n and low * w[1] <= 100 * s <= high * w[1]:
                    w[2] += 1
                    out.append((a, w[0], w[2], i, w[1], s))
            # scores only fall: a window that is full or passed never opens again
            windows = [w for w in windows if w[2] < n and 100 * s >= low * w[1]]
        types = [pa.int32() if k == 2 else pa.int64() for k in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def _blocks(anchors: DataFrame, scale: int) -> Iterator[tuple[int, Block]]:
    """The number of blocks and each block of anchors; one is held at a time."""
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-size["n"] // BLOCK), -(-size["bytes"] // BLOCK_BYTES))
    for k in range(n_blocks):
        rows = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == k).select("vec_id", "label", "embedding").toArrow().combine_chunks()
        if rows.num_rows:
            yield n_blocks, Block(*vectors(rows.to_batches()[0], scale))


def mine(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``df`` has vec_id, label and embedding; ``anchor`` tells the anchors. A negative's score lies between
    ``low`` and ``high`` per cent of its positive's; components are multiplied by ``scale`` and rounded down.
    """
    spark = df.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", anchor.alias("_anchor"))
    chosen = rows.where("_anchor AND vec_id IS NOT NULL AND label IS NOT NULL").where(finite).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x"))
    anchors = stored(chosen.select("vec_id", "x.label", "x.embedding"))
    striped = rows.drop("_anchor").coalesce(2 * spark.sparkContext.defaultParallelism)
    parts = []
    for n_blocks, block in _blocks(anchors, scale):
        bare = spark.sparkContext.broadcast(block)
        near = map_arrow(striped, lambda x, sent=bare: score_positives(x, sent.value, scale, positives), "anchor bigint, key binary")
        first = map_arrow(_sorted(near), lambda x: first_positives(x, positives), "anchor bigint, key binary").toArrow()  # a few an anchor of the block
        bare.destroy()
        keys = first.column("key").combine_chunks() if first.num_rows else pa.array([], pa.binary())
        a, s, _, _ = unpack(keys)
        block.open(list(zip(a.tolist(), s.tolist(), strict=True)), low, high)
        sent = spark.sparkContext.broadcast(block)
        far = map_arrow(striped, lambda x, sent=sent: score_negatives(x, sent.value, scale, negatives), "anchor bigint, key binary")
        both = far.unionByName(spark.createDataFrame(first, "anchor bigint, key binary"))
        part = map_arrow(_sorted(both), lambda x: emit_negatives(x, negatives, low, high), SCHEMA)
        if n_blocks > 1:
            part = stored(part)
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], SCHEMA)
