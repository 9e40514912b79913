"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every non-empty line is labelled good or bad. A line's score uses its own features and those of
its two neighbours; learnt transition weights tie neighbouring labels. Forward-backward runs in
step over all documents of an Arrow batch and gives each line's marginal; the marginals, weighted
by line length, are averaged and calibrated into the document's score.

Only documents have labels, so lines get theirs in ``ROUNDS`` expectation steps: a logistic model of
the lines' own features is fitted to the labels so far, and lines that it places on the other side
with ``SURE`` or more change theirs, the surest first, as long as less than half of the document's
length disagrees with its label. The field is then fitted to these line labels by exact gradient,
so it learns how labels change within documents. It is fitted on at most ``SAMPLE`` labelled
documents per class (smallest hashes of doc_id; of rows that share an id the smallest text), of
each at most its last ``FIT_LINES`` lines, so fitting is bounded whatever the input; scoring covers
every line of every text.

Defined results: null texts and texts without a non-empty line get the calibrated score of a
marginal of one half; without labels of both classes every score is 0.5; repeated rows give
repeated results; extra columns are ignored by ``score_documents`` and kept by ``keep_good``; very
long texts are scored whole; a document with several labels is learnt with each; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_arrow, row_slices, text_buffers
from .words import mix, word_hashes

SAMPLE, FIT_LINES, STEPS, ROUNDS, SURE = 1000, 400, 160, 3, 0.7
_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 plain mark, 5 odd mark, 6 bar, 7 space
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[33:48], _KINDS[58:65], _KINDS[91:97], _KINDS[123:127] = 5, 5, 5, 5
_KINDS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_KINDS[ord("|")], _KINDS[[9, 11, 12, 13, 32]] = 6, 7
#: Columns of a line's own features.
WIDTH = 22


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, document) of every non-empty line of the texts between the offsets."""
    if not len(raw):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # texts are parted by a newline each, so that no word runs from one into the next
    raw, offsets = np.insert(raw, offsets[1:-1], 10), offsets + np.append(np.arange(len(offsets) - 1), len(offsets) - 2)
    newline = raw == 10
    start = np.union1d(offsets[:-1][offsets[:-1] < len(raw)], np.flatnonzero(newline) + 1)
    start = start[start < len(raw)]
    end = np.append(start[1:], len(raw))
    kinds = _KINDS[raw]
    space = (kinds == 7) | newline
    filled = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    keep = filled[end] > filled[start]
    start, end = start[keep], end[keep]
    doc = np.searchsorted(offsets, start, side="right") - 1
    size = (filled[end] - filled[start]).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return c[end] - c[start]

    upper, lower, other, digits, plain, odd, bars = (count(kinds == k) for k in (2, 1, 0, 3, 4, 5, 6))
    letters = np.maximum(1, upper + lower + other / 2)
    w_start, w_end, w_hash = word_hashes(raw, space)
    w_line, w_doc = np.searchsorted(start, w_start, side="right") - 1, np.searchsorted(offsets, w_start, side="right") - 1
    n_words = np.maximum(1, np.bincount(w_line, minlength=len(start)))
    same = np.zeros(len(w_hash), bool)
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])
    again = np.bincount(w_line[same], minlength=len(start)) / n_words
    with np.errstate(over="ignore"):
        triple = mix(w_hash[:-2] + mix(w_hash[1:-1]) * np.uint64(3) + mix(mix(w_hash[2:])) * np.uint64(7)) if len(w_hash) > 2 else np.zeros(0, np.uint64)
        inside = w_doc[2:] == w_doc[:-2]
        keyed = triple[inside] + w_doc[2:][inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    _, first = np.unique(keyed, return_index=True)
    fresh, line_of = np.zeros(len(keyed), bool), w_line[2:][inside]
    fresh[first] = True
    n_triples = np.maximum(1, np.bincount(line_of, minlength=len(start)))
    repeated = np.bincount(line_of[~fresh], minlength=len(start)) / n_triples
    n_docs = len(offsets) - 1
    doc_triples = np.bincount(w_doc[2:][inside], minlength=n_docs)
    doc_repeated = (np.bincount(w_doc[2:][inside][~fresh], minlength=n_docs) / np.maximum(1, doc_triples))[doc]
    mean_word = np.bincount(w_line, (w_end - w_start).astype(float), minlength=len(start)) / n_words
    caps, odds, bar, digit = upper / letters, odd / size, bars / n_words, digits / size
    x = np.stack([
        np.ones(len(start)), np.log1p(size) / 5, n_words < 3, n_words < 8,
        caps, caps > 0.3, caps > 0.7, odds, odds > 0.03, odds > 0.12, bar, bar > 0.2,
        digit, digit > 0.1, plain / size, again, again > 0.2, repeated, repeated > 0.3, doc_repeated, doc_repeated > 0.2, np.minimum(mean_word, 40) / 10,
    ], 1).astype(np.float32)
    return x, size.astype(np.int64), doc


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, then the previous and the next line's (zero at a document's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        linked = (doc[1:] == doc[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * linked, x[1:] * linked
    return np.concatenate([x, before, after], 1)


def _message(d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds that a neighbour with log-odds ``d`` sends through transitions ``t[from, to]``."""
    return np.logaddexp(t[0, 1], d + t[1, 1]) - np.logaddexp(t[0, 0], d + t[1, 0])


def forward_backward(score: np.ndarray, doc: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward log-odds, first line's number of each document); all documents advance together."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    lengths = np.diff(np.append(first, len(doc)))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    forward, backward = score.astype(np.float64).copy(), np.zeros(len(score))
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for i in range(1, len(active)):
        at = first[: active[i]] + i
        forward[at] += _message(forward[at - 1], t)
    last = first + lengths - 1
    for i in range(1, len(active)):
        at = last[: active[i]] - i
        backward[at] = _message(score[at + 1] + backward[at + 1], t.T)
    return forward, backward, first


class Model:
    """Weights of the field and of the calibration."""

    def __init__(self, w: np.ndarray, t: np.ndarray, slope: float, shift: float):
        self.w, self.t, self.slope, self.shift = w, t, slope, shift

    def means(self, x: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Length-weighted mean marginal of ``good``; one half without lines."""
        out = np.full(n_docs, 0.5)
        if len(x):
            forward, backward, _ = forward_backward(with_neighbours(x, doc) @ self.w, doc, self.t)
            good = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
            weight = np.bincount(doc, size, minlength=n_docs)
            out = np.where(weight > 0, np.bincount(doc, good * size, minlength=n_docs) / np.maximum(weight, 1), 0.5)
        return out

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (mean - 0.5) + self.shift, -50, 50)))


def expected(score: np.ndarray, doc: np.ndarray, t: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of ``good`` of every line, expected counts of the label pairs of ``linked`` lines and their successors)."""
    forward, backward, _ = forward_backward(score, doc, t)
    right = score[linked + 1] + backward[linked + 1]
    joint = np.stack([np.full(len(linked), t[0, 0]), t[0, 1] + right, t[1, 0] + forward[linked], t[1, 1] + forward[linked] + right], 1)
    joint = np.exp(joint - joint.max(1, keepdims=True)) if len(joint) else joint
    pairs = (joint / joint.sum(1, keepdims=True)).sum(0).reshape(2, 2)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50))), pairs


def line_labels(x: np.ndarray, size: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The label of every line, from the documents' labels and the lines' own features."""
    y, own, x = label[doc].astype(np.float64), label[doc].astype(np.float64), x.astype(np.float64)
    half = np.bincount(doc, size, minlength=len(label)) / 2
    for _ in range(ROUNDS):
        w = np.zeros(x.shape[1])
        for _ in range(12):  # Newton steps of the logistic model
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            r = np.maximum(p * (1 - p), 1e-6)
            w = w + np.linalg.solve((x * r[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        against = np.where(own == 1, 1 - p, p)
        order = np.lexsort((-against, doc))
        order = order[against[order] >= SURE]
        total = np.cumsum(size[order])
        first = np.flatnonzero(np.diff(doc[order], prepend=-1))
        base = np.repeat((total - size[order])[first], np.diff(np.append(first, len(order))))
        change = order[total - base < half[doc[order]]]
        y = own.copy()
        y[change] = 1 - own[change]
    return y


def gradient(w: np.ndarray, t: np.ndarray, z: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the lines' labels, by the weights and by the transitions."""
    linked = np.flatnonzero(doc[1:] == doc[:-1])
    p, free = expected(z @ w, doc, t, linked)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[linked].astype(int), y[linked + 1].astype(int)), 1)
    return z.T @ (y - p), seen - free


def fit(x: np.ndarray, size: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam on the exact gradient; ``label`` is per document, ``doc`` counts from 0."""
    z, y = with_neighbours(x, doc).astype(np.float64), line_labels(x, size, doc, label)
    w, t = np.zeros(z.shape[1]), np.zeros((2, 2))
    n_linked = max(1, int(np.count_nonzero(doc[1:] == doc[:-1])))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        by_w, by_t = gradient(w, t, z, doc, y)
        g = np.concatenate([by_w / len(z) - penalty * w, (by_t / n_linked - penalty * t).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    model = Model(w, t, 1.0, 0.0)
    mean = model.means(x, size, doc, len(label)) - 0.5
    slope, shift = 4.0, 0.0
    for _ in range(60):  # Newton steps of the two-parameter calibration
        q = 1 / (1 + np.exp(-(slope * mean + shift)))
        r = np.maximum(q * (1 - q), 1e-6)
        h = np.array([[(r * mean * mean).sum() + 1e-2, (r * mean).sum()], [(r * mean).sum(), r.sum() + 1e-2]])
        d = np.linalg.solve(h, [((label - q) * mean).sum() - 1e-2 * slope, (label - q).sum()])
        slope, shift = slope + d[0], shift + d[1]
    return Model(w, t, float(slope), float(shift))


def _batch_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text_buffers(column)
    found = [(x, size, doc + i) for i, j in row_slices(offsets) for x, size, doc in [line_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]]
    if not found:
        return line_features(raw[:0], offsets[:1])
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents per class that are labelled and not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality").distinct()
    chosen = bounded_sample(known, "quality", sample)
    # at most 2 x SAMPLE ids, so the broadcast is bounded
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            x, size, doc = _batch_lines(b.column(2))
            count = np.bincount(doc, minlength=b.num_rows)
            ends = np.cumsum(count)
            fields = [[], []]
            for e, n in zip(ends, count, strict=True):
                n = min(n, FIT_LINES)
                fields[0].append(x[e - n : e].astype("<f4").tobytes())
                fields[1].append(size[e - n : e].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array(fields[0], pa.binary()), pa.array(fields[1], pa.binary())], ["doc_id", "quality", "x", "size"])

    rows = map_arrow(texts, run, "doc_id bigint, quality int, x binary, size binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["size"]), key=lambda r: (r["doc_id"], r["quality"]))
    if len({r["quality"] for r in rows}) < 2:
        return Model(np.zeros(3 * WIDTH), np.zeros((2, 2)), 0.0, 0.0)
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], "<i8") for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["size"]) // 8 for r in rows])
    return fit(x, size, doc, np.array([r["quality"] for r in rows]))


def _scored(model: Model, column: pa.Array) -> np.ndarray:
    x, size, doc = _batch_lines(column)
    return model.scores(model.means(x, size, doc, len(column)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document."""

    def run(batches):
        for b in batches:
            score = _scored(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, with all their columns."""
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scored(model, b.column(at)) >= least))

    return map_arrow(docs, run, schema)
