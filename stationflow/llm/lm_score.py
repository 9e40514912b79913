"""Language-model scoring from a log-frequency Bloom filter.

The model is a smoothed trigram model whose counts are kept by no table: an n-gram that occurs c times in
the training documents enters a Bloom filter as the pairs (n-gram, 1), ..., (n-gram, 1 + floor(log2 c)). Its
quantised count comes back by probing (n-gram, 1), (n-gram, 2), ... until a probe fails, and stands for the
mean of the counts of its level. An absent n-gram is taken for a rare one now and then, a present one is
never missed. Probabilities are smoothed by Dirichlet priors, each order's being the next shorter one:

    p(w) = (c(w) + 1) / (N + V + 1), p(w|v) = (c(vw) + M p(w)) / (c(v) + M), p(w|uv) = (c(uvw) + M p(w|v)) / (c(uv) + M)

A trigram counts only if both its bigrams are there, and no count exceeds its context's.

On Spark: n-grams are 64-bit hashes (60 bits or more of which tell them apart), counted in each task for about 4 MB of text and packed by the slice of
the filter they belong to; a slice's packs meet in one task, which adds them up and sets the slice's bits.
The filter has ``BITS`` bits a training token, in slices of 32 kB, written to the shared folder. It is
broadcast in blocks of ``BLOCK_SLICES`` slices (256 MB, some 200 million tokens) at most, one at a time: with one block a single pass
over the texts scores them; with more, each pass adds the levels that its block knows to a byte a token and
order, and the last one scores. The result does not depend on the number of blocks.

The base score needs exact counts. Tokens that are one in ``SHARE`` of all training tokens or more (so at most
2^20 of them, of ``LONGEST`` bytes at most: 80 MB, and usually a few) are broadcast and found by hash and
bytes; the others are joined by a shuffle, in which no token is hot since each is rare.

Defined results: null and empty texts have the end token only; very long texts and words are read whole;
documents without an id are learnt from and not held out; without training documents every token is
unknown (N = V = 0) and the base score is 0; repeated rows are learnt from and scored as often as they are
there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_slices, stored, text_buffers
from .words import WHITE, document_tokens, fold, gather, mix

#: Bits of the filter a training token, probes an entry, and the weight of a shorter order.
BITS, PROBES, WEIGHT = 10, 3, 4.0
SLICE_BITS, BLOCK_SLICES = 1 << 18, 1 << 13
#: Bytes of text whose n-grams are counted together.
COUNTED = 4 << 20
#: A token that is one in so many is looked up in a broadcast table if it has at most so many bytes.
SHARE, LONGEST = 1 << 20, 64
#: The end token: no word holds a space. The n-gram hashes of a text's begin and end.
END = b" "
_BEGIN_HASH, _END_HASH = mix(np.array([1, 2], np.uint64))
#: Means of the counts of each level.
ESTIMATE = np.concatenate([[0.0], (2.0 ** np.arange(63) + 2.0 ** np.arange(1, 64) - 1) / 2])


def held_out(doc_id: str = "doc_id"):
    """True for the seventh of the documents that are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- n-grams -------------------------------------------------------------------------------------


def padded(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of begin, begin, the words and end of each text in turn, index of each text's first)."""
    counts = np.diff(first)
    at = first + 3 * np.arange(len(first))
    out = np.empty(len(hashes) + 3 * len(counts), np.uint64)
    out[at[:-1]] = out[at[:-1] + 1] = _BEGIN_HASH
    out[at[1:] - 1] = _END_HASH
    out[np.arange(len(hashes)) + 3 * np.repeat(np.arange(len(counts)), counts) + 2] = hashes
    return out, at


def orders(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words, word pairs and word triples that end at each place; those of the second begin and later ones are in texts."""
    one = fold(hashes, 1)
    two, three = np.zeros_like(one), np.zeros_like(one)
    if len(hashes) > 1:
        two[1:] = fold(hashes, 2)
    if len(hashes) > 2:
        three[2:] = fold(hashes, 3)
    return one, two, three


def ngrams(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes of all n-grams of some texts."""
    seq, at = padded(hashes, first)
    one, two, three = orders(seq)
    inside = np.ones(len(seq), bool)
    inside[at[:-1]] = False
    later = inside.copy()
    later[at[:-1] + 1] = False
    return np.concatenate([one[inside], two[inside], three[later]])


# --- the filter ----------------------------------------------------------------------------------


def short(h: np.ndarray) -> np.ndarray:
    """The 48 bits of a hash that tell an n-gram within its slice."""
    return h >> np.uint64(16)


def _places(keys: np.ndarray, level: int) -> np.ndarray:
    """The bits of (n-gram, level) within its slice."""
    with np.errstate(over="ignore"):
        x = mix(keys ^ mix(np.full(1, level + 7, np.uint64)))
        return (x[:, None] + (x >> np.uint64(32) | np.uint64(1))[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(SLICE_BITS - 1)


def slice_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A slice of the filter from its n-grams' short keys and counts, each key once."""
    bits = np.zeros(SLICE_BITS, bool)
    level = 1
    while len(keys):
        bits[_places(keys, level).ravel().astype(np.int64)] = True
        keep = counts >= 1 << level
        keys, counts, level = keys[keep], counts[keep], level + 1
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class FilterBlock:
    """Slices ``base`` and on of a filter of ``n_slices``; plain bytes, which a task reads without a second copy."""

    packed: bytes
    base: int
    n_slices: int

    @property
    def bits(self) -> np.ndarray:
        return np.frombuffer(self.packed, np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram; 0 if it is in none of these slices."""
        keys, back = np.unique(h, return_inverse=True)
        out = np.zeros(len(keys), np.uint8)
        of = (keys % np.uint64(self.n_slices)).astype(np.int64) - self.base
        bits = self.bits
        live = np.flatnonzero((of >= 0) & (of < len(bits) * 8 // SLICE_BITS))
        level = 1
        while len(live):
            at = _places(short(keys[live]), level).astype(np.int64) + of[live][:, None] * SLICE_BITS
            live = live[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)]
            out[live] = level
            level += 1
        return out[back]


@dataclass
class Model:
    """Exact counts (token, n), the filter's slices (slice, bits), and the sums N, V and texts (= ends)."""

    counts: DataFrame
    slices: DataFrame
    n_slices: int
    tokens: int
    types: int
    ends: int

    def blocks(self) -> Iterator[FilterBlock]:
        """The filter, a block at a time."""
        for base in range(0, self.n_slices, BLOCK_SLICES):
            top = min(self.n_slices, base + BLOCK_SLICES)
            size = SLICE_BITS // 8
            bits = bytearray((top - base) * size)
            got = self.slices.where(F.col("slice").between(base, top - 1)).toArrow()
            for s, b in zip(got.column("slice").to_pylist(), got.column("bits"), strict=True):
                bits[(s - base) * size : (s - base + 1) * size] = b.as_buffer()
            yield FilterBlock(bytes(bits), base, self.n_slices)


def _words(column: pa.Array, most: int):
    """(row of the first text, words' bytes, hashes, index of each text's first word) of slices of a column."""
    raw, offsets = text_buffers(column)
    for i, j in row_slices(offsets, most):
        lower, start, end, hashes, first = document_tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WHITE)
        yield i, gather(lower, start, end), hashes, first


def count_tokens(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, tokens, _, first in _words(b.column(0), COUNTED):
            found = pa.array(tokens).value_counts()
            keys, n = found.field("values").cast(pa.binary()).to_pylist(), found.field("counts").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([*keys, END], pa.binary()), pa.array([*n, len(first) - 1], pa.int64())], ["token", "n"])


def count_ngrams(batches, n_slices: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of stretches of text by slice: short keys of six bytes and counts, packed."""
    for b in batches:
        for _, _, hashes, first in _words(b.column(0), COUNTED):
            h, n = np.unique(ngrams(hashes, first), return_counts=True)
            of = (h % np.uint64(n_slices)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            h, n, of = short(h[order]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], n[order].astype("<u4"), of[order]
            slices, at = np.unique(of, return_index=True)
            ends = np.append(at[1:], len(of))
            packs = [[x[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)] for x in (h, n)]
            yield pa.RecordBatch.from_arrays([pa.array(slices), *(pa.array(p, pa.binary()) for p in packs)], ["slice", "hashes", "counts"])


def fill_slices(batches) -> Iterator[pa.RecordBatch]:
    """The bits of each slice, from packs sorted by slice."""
    current, hashes, counts = None, [], []

    def done():
        h, back = np.unique(np.concatenate(hashes), return_inverse=True)
        bits = slice_bits(h, np.bincount(back, np.concatenate(counts), len(h)))
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([bits], pa.binary())], ["slice", "bits"])

    for b in batches:
        for s, h, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if s != current:
                if hashes:
                    yield done()
                current, hashes, counts = s, [], []
            keys = np.zeros((len(h) // 6, 8), np.uint8)
            keys[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
            hashes.append(keys.view("<u8")[:, 0])
            counts.append(np.frombuffer(n, "<u4"))
    if hashes:
        yield done()


def learn(docs: DataFrame, bits: int = BITS) -> Model:
    """The model of ``docs`` (text)."""
    texts = docs.select("text")
    counts = stored(map_arrow(texts, count_tokens, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    n_slices = max(1, -(-bits * sums["tokens"] // SLICE_BITS))
    packs = map_arrow(texts, lambda x: count_ngrams(x, n_slices), "slice bigint, hashes binary, counts binary")
    slices = stored(map_arrow(packs.repartition("slice").sortWithinPartitions("slice"), fill_slices, "slice bigint, bits binary"))
    return Model(counts, slices, n_slices, sums["tokens"], sums["types"], sums["ends"])


# --- scoring -------------------------------------------------------------------------------------


def log_probabilities(levels: np.ndarray, first: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 of each place's probability (0 at the two begins) from the levels of the orders that end there (3 x places)."""
    one, two, three = ESTIMATE[levels]
    before = lambda x: np.concatenate([[0.0], x[:-1]])  # noqa: E731  the context ends one place earlier
    three = np.where((two > 0) & (before(two) > 0), three, 0.0)
    p = np.minimum(1.0, (one + 1) / (tokens + types + 1))
    for found, context in ((two, before(one)), (three, before(two))):
        p = (np.minimum(found, context) + WEIGHT * p) / (context + WEIGHT)
    p[first[:-1]] = p[first[:-1] + 1] = 1.0
    return np.log10(p)


def probe(batches, block: FilterBlock) -> Iterator[pa.RecordBatch]:
    """Adds the levels that this block knows: doc_id, text, levels."""
    for b in batches:
        out = [x for _, _, levels, first in _levels(b, block) for x in _split(levels, first)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "text", "levels"])


def _split(levels: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield levels[:, i:j].tobytes()


def _levels(b: pa.RecordBatch, block: FilterBlock):
    """(row of the first text, (words, hashes, index of each text's first), levels so far, index of each text's first place)."""
    known = b.column(2).to_pylist() if b.num_columns > 2 else None
    for i, words, hashes, first in _words(b.column(1), 1 << 20):
        seq, at = padded(hashes, first)
        levels = np.stack([block.levels(x) for x in orders(seq)])
        # the places before a text's second begin hold pairs across texts
        levels[1, at[:-1]] = levels[2, at[:-1]] = levels[2, at[:-1] + 1] = 0
        if known:
            levels += np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in known[i : i + len(first) - 1]], 1)
        yield i, (words, hashes, first), levels, at


@dataclass
class Frequent:
    """The counts of the frequent tokens, by hash, and the sums of the base score."""

    hashes: np.ndarray
    tokens: pa.Array
    counts: np.ndarray
    n_tokens: int
    types: int
    ends: int

    @classmethod
    def of(cls, tokens: pa.Array, counts: np.ndarray, model: Model) -> Frequent:
        """Of single words."""
        raw, offsets = text_buffers(tokens)
        hashes = document_tokens(raw, offsets, WHITE)[3]
        order = np.argsort(hashes)
        return cls(hashes[order], tokens.take(pa.array(order)), counts[order], model.tokens, model.types, model.ends)

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The count of each word, -1 if it is not here; a word is its bytes, its hash only tells where to look."""
        out = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            same = pc.equal(self.tokens.take(pa.array(at[hit])), words.take(pa.array(hit)).cast(pa.binary())).to_numpy(zero_copy_only=False)
            out[hit[same]] = self.counts[at[hit[same]]]
        return out


def score_texts(batches, block: FilterBlock, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, known and base (of the frequent tokens and the end), score, and the other tokens with their numbers."""
    lost = np.log10(frequent.n_tokens + frequent.types + 1)
    for b in batches:
        columns: list[list] = [[], [], [], []]
        rare, sizes = [], [0]
        for _, (words, hashes, first), levels, at in _levels(b, block):
            score = np.add.reduceat(log_probabilities(levels, at, frequent.n_tokens, frequent.types), at[:-1])
            coded = words.dictionary_encode()
            codes, n_docs = coded.indices.to_numpy().astype(np.int64), len(first) - 1
            c = frequent.find(coded.dictionary, hashes[np.unique(codes, return_index=True)[1]])
            here = c[codes] >= 0
            doc = np.repeat(np.arange(n_docs), np.diff(first))
            base = np.bincount(doc[here], np.log10(c[codes[here]] + 1.0) - lost, n_docs) + np.log10(frequent.ends + 1) - lost
            known = np.bincount(doc[here], minlength=n_docs) + (frequent.ends > 0)
            for x, y in zip(columns, (np.diff(first) + 1, known, base, score), strict=True):
                x.append(y)
            pairs, n = np.unique(doc[~here] * max(1, len(c)) + codes[~here], return_counts=True)
            rare.append((coded.dictionary.take(pa.array(pairs % max(1, len(c)))).cast(pa.binary()), n))
            sizes.append(np.bincount(pairs // max(1, len(c)), minlength=n_docs))
        entries = pa.StructArray.from_arrays([pa.concat_arrays([x for x, _ in rare]) if rare else pa.array([], pa.binary()), pa.array(np.concatenate([n for _, n in rare]) if rare else np.zeros(0, np.int64))], ["token", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([np.atleast_1d(x) for x in sizes])).astype(np.int32)), entries)
        numbers = [np.concatenate(x) if x else np.zeros(0) for x in columns]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64 if k < 2 else np.float64)) for k, x in enumerate(numbers)), lists], ["doc_id", "n_tokens", "known", "base", "score", "rare"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = (F.col("n") * SHARE >= max(1, model.tokens)) & (F.octet_length("token") <= LONGEST)
    table = model.counts.where(frequent & (F.col("token") != END)).toArrow().combine_chunks()  # at most SHARE rows of LONGEST bytes
    tokens = pa.concat_arrays(table.column("token").chunks) if table.num_rows else pa.array([], pa.binary())
    known = Frequent.of(tokens.cast(pa.binary()), table.column("n").to_numpy(), model)
    n_blocks, found = -(-model.n_slices // BLOCK_SLICES), None
    for k, block in enumerate(model.blocks()):
        sent = spark.sparkContext.broadcast((block, known))
        if k == n_blocks - 1:
            found = map_arrow(texts, lambda x, sent=sent: score_texts(x, *sent.value), "doc_id bigint, n_tokens bigint, known bigint, base double, score double, rare array<struct<token: binary, n: bigint>>")
            found = stored(found.withColumn("row", F.monotonically_increasing_id()))
        else:
            texts = stored(map_arrow(texts, lambda x, sent=sent: probe(x, sent.value[0]), "doc_id bigint, text string, levels binary"))
        sent.destroy()
    lost = F.log10(F.lit(float(model.tokens + model.types + 1)))
    rest = found.select("row", F.explode("rare").alias("x")).select("row", "x.token", F.col("x.n").alias("times"))
    rest = rest.join(model.counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - lost)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    return found.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
