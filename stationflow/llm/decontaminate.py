"""Benchmark decontamination by SimHash windows.

Words are runs of ASCII letters and digits and non-ASCII bytes, A-Z lower-cased; shingles have
``SHINGLE`` words. For every benchmark item, windows as long as the item slide over a document
one word at a time, and the exact weighted Jaccard similarity of the shingle counts decides, at
``LEAST`` or more. No window of that similarity is lost:

* Windows that hold none of an item's rarest shingles have too few of the others and end there. All other windows
  get a 64-bit SimHash (the signs of the sums of their shingles' bits).
* Candidates come from multi-index Hamming blocks: fingerprints are cut into ``RADIUS + 1`` blocks, and items are
  looked up by length, block number and block value, so every item within the radius of a window is found. Two windows
  of similarity 0.8 differ in about 10 bits (deviation 3), so ``RADIUS`` loses next to none.
* Exact weighted Jaccard decides on each candidate; the count of shared shingles bounds it from above and ends most.
* What the radius misses is added by a pass of its own over the windows whose bound reaches ``LEAST``
  (``extra=False`` leaves it out). ``distance`` and ``by_radius`` tell which of the two found a match.

Items are taken in blocks of about ``BLOCK`` items and ``BLOCK_BYTES`` of text at most. Only one block
is at the driver and broadcast at a time: its matches are written to the shared folder and it is
released before the next one is read, so what the driver and a task hold is bounded however large
the benchmark is. Documents are read once for each block; with one block, the usual case, nothing is
written or shuffled, and with several ``drop_leaks`` joins the documents with the leaks once.

Defined results: null or empty texts and items match nothing; an item with fewer than
``SHINGLE`` words is one shingle of all its words; a document shorter than an item has one window,
itself; very long documents are read whole; an empty table of documents or of items gives no leaks; repeated rows give repeated
results; repeated items match alike; ties between windows go to the first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_slices, stored, text_buffers
from .words import NON_WORD, document_words, fold, shingle_hashes

SHINGLE, LEAST, RADIUS, BLOCK, BLOCK_BYTES = 5, 0.8, 22, 20_000, 8 << 20
_BITS = np.arange(64, dtype=np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return ((hashes[:, None] >> _BITS & np.uint64(1)).astype(np.int32) << 1) - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over sum of the larger ones, of two multisets of hashes."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Index:
    """Items by rare shingle, and fingerprints by length and block."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS, least: float = LEAST, extra: bool = True):
        self.radius, self.least, self.extra, self.ids = radius, least, extra, [i for i, _ in items]
        raw = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items], dtype=np.int64)])
        words, first = document_words(raw, offsets, NON_WORD)
        hashes, of = shingle_hashes(words, first, SHINGLE)
        self.n_words = np.diff(first)
        at = np.searchsorted(of, np.arange(len(items) + 1))
        self.shingles = [hashes[at[i] : at[i + 1]] for i in range(len(items))]
        at = at[:-1]
        # sorted (shingle, item) pairs of the items' rarest shingles, behind a bitmap of 2^20 bits
        _, which, often = np.unique(hashes, return_inverse=True, return_counts=True)
        rank = np.empty(len(of), np.int64)
        rank[np.lexsort((which, often[which], of))] = np.arange(len(of))
        total = np.diff(at, append=len(of))
        taken = rank - at[of] <= total[of] - np.ceil(least * total[of] - 1e-9)
        pairs = np.unique(np.stack([hashes[taken], of[taken].astype(np.uint64)], 1), axis=0) if len(of) else np.zeros((0, 2), np.uint64)
        self.keys, self.owners = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.short = bool((self.n_words < SHINGLE).any())
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.prints = np.array([int(pack(signs(s).sum(0)[None])[0]) if len(s) else 0 for s in self.shingles], np.uint64)
        # by length and block: the block values in order, and their items
        self.table: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.n_words[self.n_words > 0]).tolist():
            own = np.flatnonzero(self.n_words == n)
            for k, (shift, mask) in enumerate(self.blocks):
                values = self.prints[own] >> shift & mask
                order = np.argsort(values, kind="stable")
                self.table[n, k] = values[order], own[order]

    def near(self, n: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) pairs of length n within the radius, each once."""
        pairs = [np.zeros(0, np.int64)]
        for k, (shift, mask) in enumerate(self.blocks):
            if (n, k) not in self.table:
                return []
            values, items = self.table[n, k]
            wanted = prints >> shift & mask
            left, right = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            repeat = right - left
            entry = np.repeat(left - np.concatenate([[0], np.cumsum(repeat)[:-1]]), repeat) + np.arange(repeat.sum())
            pairs.append(np.repeat(np.arange(len(prints)), repeat) * len(self.ids) + items[entry])
        w, i = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.ids)))
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        return list(zip(w[close].tolist(), i[close].tolist(), strict=True))

    def matches(self, words: np.ndarray, hits: np.ndarray, owners: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of a document's best window for each item, from the places of its rare shingles."""
        best: dict[int, tuple[float, int, int, int]] = {}
        spans = self.n_words[owners]
        for n in np.unique(spans).tolist():
            size = min(n, len(words))
            wide = min(SHINGLE, size)
            if size * 1.25 < n - 1:
                continue
            # windows of fewer words than a shingle are one shingle each
            count, last = size - wide + 1, len(words) - size
            places = hits[spans == n]
            low, high = max(0, places.min() - count + 1), min(last, places.max()) + size
            own = fold(words[low:high], wide)
            starts = {}
            for i in np.unique(owners[spans == n]).tolist():
                at = np.unique((hits[owners == i][:, None] - np.arange(count)[None]).ravel())
                starts[i] = at[(at >= 0) & (at <= last)] - low
            at = np.unique(np.concatenate(list(starts.values())))
            if not len(at):
                continue
            base = int(at[0])
            summed = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(own[base : at[-1] + count]), 0, dtype=np.int32)])
            prints = pack(summed[at - base + count] - summed[at - base])
            candidates: dict[int, set[int]] = {}
            for w, i in self.near(n, prints):
                candidates.setdefault(i, set()).add(int(at[w]))
            place = {int(w): k for k, w in enumerate(at)}
            for i in sorted({*candidates, *(starts if self.extra else ())}):
                held = np.concatenate([[0], np.cumsum(np.isin(own, self.shingles[i]))])
                top, first = 0.0, -1
                # the candidates, and then what the radius has missed
                for some in (candidates.get(i, set()), set(starts.get(i, at[:0]).tolist()) - candidates.get(i, set()) if self.extra else set()):
                    windows = np.array(sorted(some), np.int64)
                    shared = held[windows + count] - held[windows]
                    bounds = shared / np.maximum(1, count + len(self.shingles[i]) - shared)
                    for w, bound in zip(windows[bounds >= self.least].tolist(), bounds[bounds >= self.least].tolist(), strict=True):
                        if bound < top or bound == top and w > first:
                            continue
                        s = weighted_jaccard(own[w : w + count], self.shingles[i])
                        if s >= self.least and (s > top or s == top and w < first):
                            top, first = s, w
                if first >= 0:
                    best[i] = (top, int(low + first), size, int(np.bitwise_count(prints[place[first]] ^ self.prints[i])))
        return [(i, start, size, s, d) for i, (s, start, size, d) in sorted(best.items())]

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
        """(document, item, first word, words, similarity, distance) of every match in some texts."""
        words, first = document_words(raw, offsets, NON_WORD)
        found: list[tuple[int, int, int, int, float, int]] = []
        sizes = [SHINGLE, *([x for x in np.unique(self.n_words[self.n_words < SHINGLE]).tolist() if x] if self.short else [])]
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for n in sizes:
            if len(words) >= n:
                h = fold(words, n)
                at = np.flatnonzero(self.gate[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = at[doc_of[at] == doc_of[at + n - 1]]
                left, right = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
                repeat = right - left
                position = np.repeat(at, repeat)
                entry = np.repeat(left - np.concatenate([[0], np.cumsum(repeat)[:-1]]), repeat) + np.arange(repeat.sum())
                hits.append((position, self.owners[entry]))
        if not hits:
            return found
        position, owners = np.concatenate([p for p, _ in hits]), np.concatenate([o for _, o in hits])
        if not len(position):
            return found
        order = np.argsort(doc_of[position], kind="stable")
        position, owners = position[order], owners[order]
        docs, begin = np.unique(doc_of[position], return_index=True)
        for d, a, b in zip(docs.tolist(), begin, np.append(begin[1:], len(position)), strict=True):
            own = words[first[d] : first[d + 1]]
            found += [(d, *m) for m in self.matches(own, position[a:b] - first[d], owners[a:b])]
        return found


def indexes(benchmark: DataFrame, block: int = BLOCK, extra: bool = True) -> tuple[int, Iterator[Index]]:
    """The number of blocks of items, and one index for each; a block has about ``block`` items and ``BLOCK_BYTES``."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-size["n"] // block), -(-size["bytes"] // BLOCK_BYTES))

    def each():
        for k in range(n_blocks):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toArrow().to_pylist()
            yield Index(sorted(((r["item_id"], r["text"].encode()) for r in rows), key=repr), extra=extra)

    return n_blocks, each()


def _found(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, float, int]]:
    raw, offsets = text_buffers(column)
    return [(d + i, *m) for i, j in row_slices(offsets) for d, *m in index.scan(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]


def _by_block(docs: DataFrame, benchmark: DataFrame, block: int, schema: str, rows_of, extra: bool = True) -> DataFrame:
    """What ``rows_of(index, batch)`` gives over all blocks of items."""
    spark, parts = docs.sparkSession, []
    n_blocks, each = indexes(benchmark, block, extra)
    for index in each:
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in batches:
                yield rows_of(sent.value, b)

        part = map_arrow(docs, run, schema)
        if n_blocks > 1:
            part = stored(part)
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, extra: bool = True) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of each leaked item's best window, its fingerprint's distance and whether that is within the radius."""

    def rows_of(index: Index, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, index.ids[i], s, n, x, far, far <= index.radius) for d, i, s, n, x, far in _found(index, b.column(1))]
        ids = b.column(0).cast(pa.int64()).to_pylist()
        columns = [[ids[r[0]] for r in rows], *([r[k] for r in rows] for k in range(1, 7))]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance", "by_radius"])

    return _by_block(docs.select("doc_id", "text"), benchmark, block, "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double, distance bigint, by_radius boolean", rows_of, extra)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents without a leaked item, with all their columns."""
    n_blocks, each = indexes(benchmark, block)
    if n_blocks > 1:
        # the leaks of all blocks by id and text: a row is dropped for its own text only
        leaks = _by_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text"), benchmark, block, "leak_id bigint, leak_row bigint", lambda index, b: pa.RecordBatch.from_arrays(list(b.take(pa.array(sorted({r[0] for r in _found(index, b.column(2))}), pa.int64())).columns[:2]), ["leak_id", "leak_row"])).distinct()
        return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["leak_row"]), "left_anti")
    at, schema = docs.columns.index("text"), docs.schema
    for index in each:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in _found(sent.value, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        return map_arrow(docs, run, schema)
    return docs
