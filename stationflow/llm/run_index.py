"""Suffix-array dedup with a run-length index.

Every byte covered by an ``L``-byte string that also starts in a document with a smaller id goes.

Parsing. A text's L-byte windows are grouped into phrases: runs of windows with the same smallest
k-gram hash (their anchor), at most ``PHRASE`` windows each. Equal windows have equal anchors, so
only phrases with the same anchor can share a window; that holds for every repeat, whatever its
place. Phrases are dealt out by anchor as packed numbers, not text. A phrase that occurs whole in
a smaller document is gone at once (told by 102 bits: anchor, content, flanks and length): first
within a slice of text, so that copies are reduced before the shuffle, then within the anchor's
bucket. Like the dictionary of a prefix-free parse, each distinct phrase stays once, at its
smallest document. Buckets grow in number with the input, not in size; a slice is cut into at most
``FAN`` groups of them, and where there are more, groups are cut again in a further round.

Index. Distinct phrases whose anchor has other distinct phrases come back as text, again dealt
out by anchor. The phrases of a block that can be another's source become a run-compressed
Burrows-Wheeler transform with suffix-array samples at both ends of every run, and the smallest
document of each class of rows that share L bytes. The phrases that can have a smaller source
stream through it backwards, all together: a step keeps the row while the run has the pattern's
symbol and otherwise jumps to the nearer end of a neighbouring run that has it, whichever sampled
suffix shares more with what was matched. That gives every window's matching statistic; where it
reaches L and the class has a smaller document, the window is marked.

A hot anchor (one with more than ``FLAGGED`` distinct phrases in a slice of some task) is not
gathered in a bucket: its phrases go on as they are, and markers tell its bucket to pass on the
rest. An anchor whose phrases are more than ``INDEX_BYTES`` is not a block: its windows are grouped
by their bytes, reduced to the smallest document in every task first, and the marks return by a join.

Marks return to their documents by id; the text itself is shuffled (compressed) once for
the second round and once for the result, and never gathered.

Defined results: null reads as empty; texts shorter than L keep everything; matches never cross
documents; rows with one id are one document and do not remove each other's bytes, and each gets
its own result; null ids come after all others (and count as one document); extra columns are
ignored; very long texts are read whole; an empty table gives no rows. Rows of one id are told apart by 23 bits of
their text: two different texts of one id share their marks with a chance of one in 8 million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lists, map_arrow, row_slices, stored, text_buffers
from .words import mix, powers

#: Most windows of a phrase (a 64-bit mask holds their marks).
PHRASE = 64
#: Bytes of text that are packed together.
PACKED_BYTES = 12 << 20
#: Bytes of phrases that one block of the index holds, and packed phrases that one bucket should hold.
INDEX_BYTES, BUCKET = 1 << 20, 3 << 20
#: Groups that a slice is cut into, tasks that judge, and distinct phrases of one anchor in one slice beyond which it is hot.
FAN, TASKS, FLAGGED = 2048, 1 << 16, 64
#: What a blob holds: phrases to judge, phrases that are gone, phrases of hot anchors, hot anchors.
JUDGE, GONE, HOT, MARKERS = range(4)
LAST = (1 << 63) - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every run of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def phrases(raw: np.ndarray, offsets: np.ndarray, length: int, flanks: bool = False) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, document, first window, windows, flanks) of every phrase of some texts."""
    k = length // 3
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 2), np.uint8)
    if len(raw) < length:
        return none
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        summed = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=summed[1:])
        grams = mix((summed[k:] - summed[:-k]) * down[: len(raw) - k + 1])
    least = sliding_min(grams, length - k + 1)
    n = len(least)
    sizes = np.diff(offsets)
    starts, ends = offsets[:-1][sizes >= length], offsets[1:][sizes >= length] - length + 1
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[starts] = True
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    run = np.flatnonzero(new & inside)
    if not len(run):
        return none
    at = np.arange(n)
    head = np.zeros(n, np.int64)
    head[run] = run
    head = np.maximum.accumulate(head)
    first = np.flatnonzero(inside & ((at - head) % PHRASE == 0))
    last = np.append(first[1:], n)
    doc = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(last, offsets[doc + 1] - length + 1)
    with np.errstate(over="ignore"):
        content = mix((summed[last + length - 1] - summed[first]) * down[first] + (last - first).astype(np.uint64))
        sides = none[5] if not flanks else _flanks(grams, least, first, last, length, k, summed, down, offsets[doc], offsets[doc + 1])
    return least[first], content, doc, first - offsets[doc], last - first, sides


def _flanks(grams, least, first, last, length, k, summed, down, begin, end) -> np.ndarray:
    """One byte each for what stands left and right of a phrase's anchor.

    A window reaches at least half of its other bytes to one side of the anchor, so two phrases
    that share a window agree on one flank. 0: no such flank in this document (agrees with none);
    255: the anchor occurs more than once (agrees with all).
    """
    wide, half = length - k + 1, (length - k + 1) // 2
    out = np.zeros((len(first), 2), np.uint8)
    for i in range(0, len(first), 1 << 14):
        f, t = first[i : i + (1 << 14)], last[i : i + (1 << 14)]
        here = grams[f[:, None] + np.arange(wide)] == least[f][:, None]
        at = f + here.argmax(1)
        again = (here.sum(1) > 1) | (t - f > wide)
        there = grams[t[:, None] - 1 + np.arange(wide)] == least[f][:, None]
        again |= (there.sum(1) > 1) | (f + wide < t - 1 + wide) & (there & (t[:, None] - 1 + np.arange(wide) > at[:, None])).any(1)
        left, right = at - half, at + k + half
        for side, (a, b, there_is) in enumerate(((left, at, left >= begin[i : i + (1 << 14)]), (at + k, right, right <= end[i : i + (1 << 14)]))):
            a, b = np.where(there_is, a, 0), np.where(there_is, b, 0)
            value = (mix((summed[b] - summed[a]) * down[a]) >> np.uint64(32)) % np.uint64(254) + np.uint64(1)
            out[i : i + (1 << 14), side] = np.where(again, 255, np.where(there_is, value, 0))
    return out


def short_anchor(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(24)


def short_content(content: np.ndarray) -> np.ndarray:
    return content >> np.uint64(24)


#: Bytes of a packed phrase: anchor, content, flanks, windows; then the first window (3 or 4) and the document's number (2 or 4).
_PARTS = (5, 5, 2, 1)


def _pack(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, flanks: np.ndarray, first: np.ndarray, n: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> bytes:
    """40 bits of anchor, 40 bits of content, flanks, place and a document number each, after the documents' ids and tags."""
    own, at = np.unique(doc, return_inverse=True)
    many, far = len(own) > 65535, bool(len(first)) and int(first.max()) >= 1 << 24
    columns = (anchor.astype("<u8"), content.astype("<u8"), flanks, n.astype(np.uint8), first.astype("<u4"))
    parts = [np.ascontiguousarray(x.view(np.uint8).reshape(len(anchor), -1)[:, :size]).tobytes() for x, size in zip(columns, (*_PARTS, 3 + far), strict=True)]
    head = np.array([len(own), len(anchor), many, far], "<i8").tobytes()
    return b"".join([head, ids[own].astype("<i8").tobytes(), tags[own].astype("<i4").tobytes(), *parts, at.astype("<u4" if many else "<u2").tobytes()])


def _columns(blob: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, content, document id, tag, flanks, first window, windows) of a packed block."""
    n_docs, n, many, far = np.frombuffer(blob, "<i8", 4).tolist()
    raw, at, columns = np.frombuffer(blob, np.uint8), 32 + 12 * n_docs, []
    for size in (*_PARTS, 3 + far):
        columns.append(raw[at : at + size * n].reshape(n, size))
        at += size * n

    def number(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, : x.shape[1]] = x
        return out.view("<u8")[:, 0]

    doc = np.frombuffer(raw[at:].tobytes(), "<u4" if many else "<u2")
    ids, tags = np.frombuffer(blob, "<i8", n_docs, 32), np.frombuffer(blob, "<i4", n_docs, 32 + 8 * n_docs)
    return number(columns[0]), number(columns[1]), ids[doc], tags[doc].astype(np.int64), columns[2], number(columns[4]).view(np.int64), columns[3][:, 0]


def _whole(content: np.ndarray, flanks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """40 bits of content with the flanks and the number of windows; equal phrases have these equal too."""
    return content << np.uint64(24) | flanks[:, 1].astype(np.uint64) << np.uint64(16) | flanks[:, 0].astype(np.uint64) << np.uint64(8) | n.astype(np.uint64)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, whole content, document id, flanks, span) of a packed block; a span is tag, first window and windows in one number."""
    anchor, content, doc, tag, flanks, first, n = _columns(blob)
    return anchor, _whole(content, flanks, n), doc, flanks, tag << 40 | first << 8 | n


def _order(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The order by (anchor, content); only entries that tie on 64 bits are compared further."""
    key = anchor << np.uint64(24) | content >> np.uint64(40)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(tied):
        own = order[tied]
        order[tied] = own[np.lexsort((content[own], key[own]))]
    return order


def _spread(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each entry's group has entries of different documents; groups are 64-bit values."""
    order = np.argsort(group)
    head = np.flatnonzero(np.diff(group[order].view(np.int64), prepend=group[order][:1].view(np.int64) - 1)) if len(group) else np.zeros(0, int)
    out = np.zeros(len(group), bool)
    if len(head):
        size = np.diff(np.append(head, len(group)))
        out[order] = np.repeat(np.minimum.reduceat(doc[order], head) != np.maximum.reduceat(doc[order], head), size)
    return out


def judge(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, flanks: np.ndarray, span: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, span, mask, anchor or 0): mask -1 where a smaller document has the whole phrase, 0 where the index must tell.

    The index must tell the smallest document of a phrase if other phrases of other documents
    have its anchor and agree on a flank, or if its anchor is hot somewhere.
    """
    if not len(anchor):
        return doc, span, doc, doc
    order = _order(anchor, content)
    anchor, content, doc, flanks, span = anchor[order], content[order], doc[order], flanks[order], span[order]
    new_a = np.ones(len(anchor), bool)
    new_a[1:] = anchor[1:] != anchor[:-1]
    new_c = new_a.copy()
    new_c[1:] |= content[1:] != content[:-1]
    head = np.flatnonzero(new_c)
    size = np.diff(np.append(head, len(doc)))
    least = np.minimum.reduceat(doc, head)
    of_a = (np.cumsum(new_a) - 1)[head]
    several = np.flatnonzero(np.bincount(of_a)[of_a] > 1)
    group, side, own = anchor[head[several]], flanks[head[several]], least[several]
    told = np.zeros(len(several), bool)
    with np.errstate(over="ignore"):
        for i in (0, 1):
            value = np.where(side[:, i] == 0, np.uint64(1000) + np.arange(len(side), dtype=np.uint64), side[:, i].astype(np.uint64))
            told |= _spread(mix(group * np.uint64(2) + np.uint64(i)) + mix(value), own)
    loose = (side == 255).any(1)
    told |= np.isin(group, group[loose]) & _spread(group, own)
    open_ = np.zeros(len(head), bool)
    open_[several[told]] = True
    open_ |= np.isin(anchor[head], hot)
    whole = doc > np.repeat(least, size)
    keep = whole | np.repeat(open_, size)
    return doc[keep], span[keep], np.where(whole[keep], -1, 0), np.where(whole[keep], 0, anchor[keep].view(np.int64))


class RunLengthIndex:
    """Run-compressed BWT of some texts, each ended by its own separator, in the order given.

    ``length`` is at least 7. Symbols are bytes plus 1, separators are 0 and sort in text order.
    Foreign patterns stream through it; a block is small, so runs of rows are found by lookup.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int):
        self.length, self.n_texts = length, len(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        n = int(ends[-1]) + 1 if len(texts) else 0
        symbol = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
        self.text = symbol
        rows, at_length = self._sort(symbol, np.repeat(ends, self.sizes + 1) - np.arange(n), length)
        before = symbol[rows - 1]  # what a separator stands before is never stepped over
        head = np.flatnonzero(np.diff(before.astype(np.int32), prepend=-1))
        lengths = np.diff(np.append(head, n))
        self.run_start, self.run_end, self.run_symbol = head, head + lengths - 1, before[head].astype(np.int64)
        self.run_first, self.run_last = rows[head], rows[self.run_end]  # suffix-array samples at run ends
        order = np.argsort(self.run_symbol, kind="stable")
        self.run_target = np.empty(len(head), np.int64)  # where the first row of each run steps to
        self.run_target[order] = np.concatenate([[0], np.cumsum(lengths[order])[:-1]]) if len(head) else 0
        self.ordered_runs = self.run_symbol[order] * (len(head) + 1) + order  # by symbol, then by place
        self.run_of = np.repeat(np.arange(len(head)), lengths)
        doc_of = np.repeat(np.asarray(docs), self.sizes + 1)[rows]
        start = np.flatnonzero(~at_length)
        self.class_least = np.minimum.reduceat(doc_of, start) if n else doc_of
        self.class_of = np.cumsum(~at_length) - 1

    @staticmethod
    def _sort(symbol: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, whether a row shares ``length`` bytes with the row before), by prefix doubling from 7 bytes on.

        ``left``: bytes up to the suffix's separator. Suffixes that are equal up to their separators stand in text order.
        """
        n = len(symbol)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        key, wide = np.zeros(n, np.int64), np.append(symbol, np.zeros(7, np.uint16)).astype(np.int64)
        for i in range(7):
            key = key << 9 | np.where(left > i, wide[i : i + n], 0)
        order = np.argsort(key, kind="stable")
        new = left[order] < 7
        new[1:] |= key[order][1:] != key[order][:-1]
        new[0] = True
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        depth, kept, kept_depth = 7, rank, 7
        while True:
            if depth <= length:
                kept, kept_depth = rank.copy(), depth
            loose = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)  # only suffixes that still tie are sorted again
            if not len(loose):
                break
            ended = left[loose] < 2 * depth
            pair = rank[loose] * n + rank[loose + depth]
            own = np.argsort(pair, kind="stable")
            r, p, e = rank[loose][own], pair[own], ended[own]
            group = np.ones(len(own), bool)
            group[1:] = r[1:] != r[:-1]
            new = group | e
            new[1:] |= p[1:] != p[:-1]
            place = np.arange(len(own)) - np.flatnonzero(group)[np.cumsum(group) - 1]
            rank[loose[own]] = r + place[np.flatnonzero(new)[np.cumsum(new) - 1]]
            depth *= 2
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)
        # two blocks of a doubled depth that overlap cover ``length`` bytes
        first, second = kept[rows], kept[np.minimum(rows + length - kept_depth, n - 1)]
        far = left[rows] >= length
        same = np.zeros(n, bool)
        same[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & far[1:] & far[:-1]
        return rows, same

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol before, row after one backward step) of some rows."""
        run = self.run_of[rows]
        return self.run_symbol[run], self.run_target[run] + rows - self.run_start[run]

    def least_documents(self, rows: np.ndarray) -> np.ndarray:
        """The smallest document of each row's class: of all places that share ``length`` bytes with it."""
        return self.class_least[self.class_of[rows]]

    def jump(self, run: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest runs above and below with ``symbols``; -1 where there is none. A run that has the symbol is its own lower one."""
        wide = len(self.run_symbol) + 1
        key = symbols * wide + run
        at = np.searchsorted(self.ordered_runs, key)
        low, high = self.ordered_runs[np.maximum(at - 1, 0)], self.ordered_runs[np.minimum(at, len(self.ordered_runs) - 1)]
        above = np.where((at > 0) & (low // wide == symbols), low % wide, -1)
        below = np.where((at < len(self.ordered_runs)) & (high // wide == symbols), high % wide, -1)
        return above, below

    def common(self, places: np.ndarray, codes: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols, ``most`` at most, the text from ``places`` on shares with ``codes`` from ``at`` on."""
        step = np.arange(int(most.max()) if len(most) else 0)
        same = self.text[np.minimum(places[:, None] + step, len(self.text) - 1)] == codes[np.minimum(at[:, None] + step, len(codes) - 1)]
        same &= step < most[:, None]
        return np.where(same.all(1), same.shape[1], same.argmin(1)) if same.shape[1] else np.zeros(len(places), np.int64)

    def statistics(self, patterns: list[bytes], cap: int):
        """Streams foreign patterns backwards together; yields (patterns, place in them, match length, place in the text, row).

        A length beyond ``cap`` may be told as less, but never as less than ``cap``.
        """
        sizes = np.array([len(x) for x in patterns], np.int64)
        codes = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        order = np.argsort(-sizes, kind="stable")
        ends, left = np.cumsum(sizes)[order], sizes[order]
        row, place, length = (np.zeros(len(order), np.int64) for _ in range(3))
        for done in range(1, int(left[0]) + 1 if len(left) and len(self.text) else 1):
            n = int(np.searchsorted(-left, -done, side="right"))
            at, row, place, length = ends[:n] - done, row[:n], place[:n], length[:n]
            symbol, run = codes[at], self.run_of[row]
            stays = (length > 0) & (self.run_symbol[run] == symbol)
            jumps = np.flatnonzero(~stays)
            if len(jumps):
                most = np.minimum(length[jumps], cap)
                best = np.full(len(jumps), -1)
                for ends_of, samples, runs in ((self.run_end, self.run_last, 0), (self.run_start, self.run_first, 1)):
                    found = self.jump(run[jumps], symbol[jumps])[runs]
                    there = np.flatnonzero(found >= 0)
                    shared = self.common(samples[found[there]], codes, at[jumps[there]] + 1, most[there])
                    better = shared > best[there]
                    there, shared = there[better], shared[better]
                    best[there] = shared
                    row[jumps[there]], place[jumps[there]] = ends_of[found[there]], samples[found[there]]
                length[jumps] = best
            known = np.flatnonzero(length >= 0)
            row[known] = self.step(row[known])[1]
            place[known] -= 1
            length += 1  # a symbol that the text has nowhere: -1 becomes 0
            yield order[:n], left[:n] - done, length, place, row

    def marks(self, patterns: list[bytes], docs: np.ndarray) -> np.ndarray:
        """A bit per window of each pattern (at most 64 windows): an indexed text of a smaller document has it."""
        out, docs = np.zeros(len(patterns), np.uint64), np.asarray(docs)
        for which, at, length, _, row in self.statistics(patterns, self.length):
            far = np.flatnonzero(length >= self.length)
            hit = far[self.least_documents(row[far]) < docs[which[far]]]
            out[which[hit]] |= np.uint64(1) << at[hit].astype(np.uint64)
        return out.view(np.int64)


def _tag():
    """Tells rows of one id with different texts apart (a 23-bit hash of the text)."""
    return F.expr(f"xxhash64(text) & {(1 << 23) - 1}L").alias("tag")


def _tag_of(span: str):
    return F.shiftright(span, 40).alias("tag")


def _document(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc")


def _packed_texts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, doc, tag and the compressed text; this is what is shuffled when a text must move."""
    schema = docs.select(*columns).schema.add("doc", "long").add("tag", "long").add("packed", "binary")

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=6)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([squeeze.compress(x) for x in byte_lists(b.columns[-1])], pa.binary())], schema.names)

    return map_arrow(docs.select(*columns, _document(), _tag(), "text"), run, schema)


_DEALT = "bucket int, kind int, part int, blob binary"


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.int32()) for k in range(3)), pa.array([x[3] for x in found], pa.binary())], ["bucket", "kind", "part", "blob"])


def _cut_blobs(columns: tuple[np.ndarray, ...], buckets: int, width: int, part: int) -> list[tuple[int, int, int, bytes]]:
    """Phrases as blobs by their group of ``width`` buckets."""
    anchor, content, doc, tag, flanks, first, n = columns
    group = (anchor % np.uint64(buckets)).astype(np.int64) // width
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.diff(group[order], prepend=-1))
    out = []
    for o in np.split(order, edge[1:]) if len(order) else []:
        out.append((int(group[o[0]]), JUDGE, part, _pack_rows(tuple(x[o] for x in columns))))
    return out


def _pack_rows(columns: tuple[np.ndarray, ...]) -> bytes:
    anchor, content, doc, tag, flanks, first, n = columns
    own, at = np.unique(np.stack([doc, tag], 1), axis=0, return_inverse=True) if len(doc) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    return _pack(anchor, content, at.reshape(-1), flanks, first, n, own[:, 0], own[:, 1])


def _first_round(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, span, mask, anchor) of the phrases that are gone (-1) or must be indexed (0)."""
    width = -(-buckets // FAN)

    def pack(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column(2))
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for low, high in row_slices(offsets, PACKED_BYTES):
                own = offsets[low : high + 1] - offsets[low]
                part = raw[offsets[low] : offsets[high]]
                found = [(a, c, d + i, f, n, s) for i, j in row_slices(own) for a, c, d, f, n, s in [phrases(part[own[i] : own[j]], own[i : j + 1] - own[i], length, True)]]
                a, c, d, f, n, s = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(a):
                    continue
                a, c = short_anchor(a), short_content(c)
                content, doc = _whole(c, s, n), ids[low:high][d]
                order = _order(a, content)
                new_a = np.ones(len(order), bool)
                new_a[1:] = a[order][1:] != a[order][:-1]
                new_c = new_a.copy()
                new_c[1:] |= content[order][1:] != content[order][:-1]
                head = np.flatnonzero(new_c)
                least = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(order))))
                of_a = np.cumsum(new_a) - 1
                hot_a = np.bincount(of_a[head]) > FLAGGED
                gone, hot = doc[order] > least, hot_a[of_a]
                columns = (a, c, doc, tags[low:high][d].astype(np.int64), s, f, n)
                salt = int(a[0] >> np.uint64(3)) & 0x7FFFFFFF
                rows = _cut_blobs(tuple(x[order[~gone & ~hot]] for x in columns), buckets, width, salt)
                rows += [(salt % -(-buckets // width), kind, salt, _pack_rows(tuple(x[order[those]] for x in columns))) for kind, those in ((GONE, gone), (HOT, ~gone & hot)) if those.any()]
                hot_anchors = a[order][new_a & hot]
                group = (hot_anchors % np.uint64(buckets)).astype(np.int64) // width
                rows += [(int(k), MARKERS, salt, hot_anchors[group == k].astype("<u8").tobytes()) for k in np.unique(group)]
                yield _rows(rows)

    def again(wide: int, narrow: int):
        """Cuts groups of ``wide`` buckets into groups of ``narrow`` ones, a slice's worth of phrases at a time."""

        def run(batches):
            held: dict[int, list[bytes]] = {}
            sizes: dict[int, int] = {}

            def cut_group(k):
                sizes.pop(k)
                return _rows(_cut_blobs(tuple(np.concatenate(x) for x in zip(*map(_columns, held.pop(k)), strict=True)), buckets, narrow, k))

            for b in batches:
                other = []
                for k, kind, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == JUDGE:
                        held.setdefault(k, []).append(blob)
                        sizes[k] = sizes.get(k, 0) + len(blob)
                        if sizes[k] >= PACKED_BYTES:
                            yield cut_group(k)
                    elif kind == MARKERS:
                        anchors = np.frombuffer(blob, "<u8")
                        group = (anchors % np.uint64(buckets)).astype(np.int64) // narrow
                        other += [(int(x), kind, part, anchors[group == x].tobytes()) for x in np.unique(group)]
                    else:
                        other.append((part % -(-buckets // narrow), kind, part, blob))
                if other:
                    yield _rows(other)
            for k in list(held):
                yield cut_group(k)

        return run

    def told(found: tuple[np.ndarray, ...]):
        by_doc = np.argsort(found[0])
        for i in range(0, len(by_doc), 1 << 17):
            o = by_doc[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x[o]) for x in found], ["doc", "span", "mask", "anchor"])

    def unpack(batches):
        held: dict[int, list[bytes]] = {}
        marked: dict[int, list[np.ndarray]] = {}
        last = None

        def judged(k):
            blobs, hot = held.pop(k, []), np.unique(np.concatenate([np.zeros(0, np.uint64), *marked.pop(k, [])]))
            pieces = max(1, sum(map(len, blobs)) // (8 * BUCKET))
            for piece in range(pieces if blobs else 0):
                parts = [tuple(x[own] for x in c) for c in map(_unpack, blobs) for own in [c[0] // np.uint64(buckets) % np.uint64(pieces) == piece]]
                yield from told(judge(*(np.concatenate(x) for x in zip(*parts, strict=True)), hot))

        for b in batches:
            for k, kind, _, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if in_order and last is not None and k != last:
                    yield from judged(last)
                last = k
                if kind == JUDGE:
                    held.setdefault(k, []).append(blob)
                elif kind == MARKERS:
                    marked.setdefault(k, []).append(np.frombuffer(blob, "<u8"))
                else:
                    anchor, _, doc, _, span = _unpack(blob)
                    gone = kind == GONE
                    yield from told((doc, span, np.full(len(doc), -1 if gone else 0), np.zeros(len(doc), np.int64) if gone else anchor.view(np.int64)))
        for k in list(held):
            yield from judged(k)

    dealt = map_arrow(docs.select(_document(), F.coalesce(_tag(), F.lit(0)).alias("tag"), "text"), pack, _DEALT)
    while width > 1:
        narrow = -(-width // FAN)
        spread = max(1, width * BUCKET // (16 * PACKED_BYTES))  # tasks that cut one group again
        dealt = map_arrow(dealt.repartition(min(TASKS, FAN * spread), "bucket", F.pmod("part", F.lit(spread))), again(width, narrow), _DEALT)
        width = narrow
    in_order = buckets > TASKS
    dealt = dealt.repartition(min(TASKS, buckets), "bucket")
    return map_arrow(dealt.sortWithinPartitions("bucket") if in_order else dealt, unpack, "doc bigint, span bigint, mask bigint, anchor bigint")


def _hot_anchors(unsure: DataFrame, length: int) -> DataFrame:
    """(anchor, hot) of the anchors whose phrases are more than a block of the index; at most one per ``INDEX_BYTES``."""
    return unsure.groupBy("anchor").agg(F.sum((F.col("span").bitwiseAND(255)) + length).alias("n")).where(F.col("n") > INDEX_BYTES).select("anchor", F.lit(True).alias("hot"))


def _window_marks(fetched: DataFrame, length: int) -> DataFrame:
    """(doc, span, mask) of phrases, by the bytes of their windows and without an index."""
    windows = fetched.select("doc", "span", "phrase", F.explode(F.sequence(F.lit(0), (F.col("span").bitwiseAND(255) - 1).cast("int"))).alias("at")).select("doc", "span", "at", F.expr(f"substring(phrase, at + 1, {length})").alias("window"))
    # written first, so that both sides of the join are exchanges and Spark can split a hot window
    least = stored(windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    return windows.join(least, "window").where("least < doc").groupBy("doc", "span").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def _second_round(packed: DataFrame, unsure: DataFrame, length: int) -> DataFrame:
    """(doc, span, mask) of the phrases whose windows the index has marked."""
    hot = stored(_hot_anchors(unsure, length))
    any_hot = not hot.isEmpty()
    if any_hot:
        unsure = unsure.join(F.broadcast(hot), "anchor", "left")
    wanted = unsure.groupBy("doc", _tag_of("span")).agg(F.collect_list(F.struct("anchor", "span", "hot") if any_hot else F.struct("anchor", "span")).alias("spans"))

    names, kinds = ["anchor", "doc", "span", "phrase", *(["hot"] if any_hot else [])], {"phrase": pa.binary(), "hot": pa.bool_()}

    def fetch(batches):
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for doc, tag, blob, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                data = open_.decompress(blob)
                found = spans.values.filter(pc.equal(pc.shift_right(spans.values.field(1), 40), tag or 0))
                anchor, span = found.field(0).to_pylist(), found.field(1).to_pylist()
                columns[0] += anchor
                columns[1] += [doc] * len(span)
                columns[2] += span
                columns[3] += [data[at : at + (x & 255) + length - 1] for x in span for at in [x >> 8 & 0xFFFFFFFF]]
                if any_hot:
                    columns[4] += [bool(x) for x in found.field(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, columns, strict=True)], names)

    def index(batches):
        anchors, docs, spans, texts, size, last = [], [], [], [], 0, None

        def emit():
            own = np.array(docs, np.int64)
            start = np.flatnonzero(np.diff(np.array(anchors, np.int64), prepend=anchors[0] - 1 if anchors[0] > 0 else 1))
            repeat = np.diff(np.append(start, len(own)))
            # the largest document of an anchor is no source, the smallest has none
            source = np.flatnonzero(own < np.repeat(np.maximum.reduceat(own, start), repeat))
            streamed = np.flatnonzero(own > np.repeat(np.minimum.reduceat(own, start), repeat))
            mask = RunLengthIndex([texts[i] for i in source], own[source], length).marks([texts[i] for i in streamed], own[streamed])
            hit = mask != 0
            return pa.RecordBatch.from_arrays([pa.array(own[streamed][hit]), pa.array(np.array(spans, np.int64)[streamed][hit]), pa.array(mask[hit])], ["doc", "span", "mask"])

        for b in batches:
            for anchor, doc, span, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= INDEX_BYTES and anchor != last:
                    yield emit()
                    anchors, docs, spans, texts, size = [], [], [], [], 0
                anchors.append(anchor)
                docs.append(doc)
                spans.append(span)
                texts.append(text)
                size += len(text) + 1
                last = anchor
        if docs:
            yield emit()

    fetched = map_arrow(packed.join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", "spans"), fetch, "anchor bigint, doc bigint, span bigint, phrase binary" + ", hot boolean" * any_hot)
    if any_hot:
        phrases_of = stored(fetched)
        fetched, windows = phrases_of.where("NOT hot").drop("hot"), _window_marks(phrases_of.where("hot"), length)
    marked = map_arrow(fetched.repartition("anchor").sortWithinPartitions("anchor"), index, "doc bigint, span bigint, mask bigint")
    return marked.union(windows) if any_hot else marked


def find_marks(docs: DataFrame, length: int) -> DataFrame:
    """(doc, tag, marks: array of (span, mask)) of every text that loses bytes; texts that share an id have marks of their own."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about 18 packed bytes a phrase, two phrases in a stretch of as many windows as a phrase can have
    buckets = max(32, -(-int(total) * 36 // ((length - length // 3 + 2) * BUCKET)))
    first = stored(_first_round(docs, length, buckets))
    unsure = first.where("mask = 0")
    second = _second_round(_packed_texts(docs, []), unsure, length)
    gone = first.where("mask != 0").select("doc", "span", "mask").union(second)
    return gone.groupBy("doc", _tag_of("span")).agg(F.collect_set(F.struct("span", "mask")).alias("marks"))


def covered(size: int, tag: int, spans: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes go, from the marks of its phrases."""
    out = np.zeros(size + 1, np.int32)
    own = spans >> 40 == tag  # rows of one id with other texts have marks of their own
    first, n, mask = spans[own] >> 8 & 0xFFFFFFFF, spans[own] & 255, masks[own].view(np.uint64)
    full = mask == np.uint64(LAST * 2 + 1)
    np.add.at(out, first[full], 1)
    np.add.at(out, first[full] + n[full] + length - 1, -1)
    place = np.arange(PHRASE, dtype=np.int64)
    gone = (mask[~full][:, None] >> place.astype(np.uint64) & np.uint64(1)).astype(bool) & (place < n[~full][:, None])
    starts = (first[~full][:, None] + place)[gone]
    np.add.at(out, starts, 1)
    np.add.at(out, starts + length, -1)
    return np.cumsum(out[:-1]) > 0


def _with_marks(docs: DataFrame, columns: list[str], length: int) -> DataFrame:
    return _packed_texts(docs, columns).join(find_marks(docs, length), ["doc", "tag"], "left")


def dedup_digests(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, tag, blob, marks in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                raw = np.frombuffer(open_.decompress(blob), np.uint8)
                if marks.is_valid and len(raw) >= length:
                    gone = covered(len(raw), tag or 0, *(marks.values.field(i).to_numpy() for i in (0, 1)), length)
                    rows.append((doc_id, len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1)), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
                else:
                    rows.append((doc_id, len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(5)], names)

    marked = _with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], length)
    return map_arrow(marked.select("doc_id", "tag", "packed", "marks"), run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int) -> DataFrame:
    """The documents with repeated strings cut out of ``text``, with all their columns.

    A character goes only if all its bytes go, so texts stay valid; ``n_chars`` follows
    where it is there (a null text keeps its own).
    """
    others = [c for c in docs.columns if c != "text"]
    schema = docs.schema

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            texts = []
            for null, tag, blob, marks in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), b.column(4), strict=True):
                raw = np.frombuffer(open_.decompress(blob), np.uint8)
                if marks.is_valid and len(raw) >= length:
                    gone = covered(len(raw), tag or 0, *(marks.values.field(i).to_numpy() for i in (0, 1)), length)
                    of = np.cumsum((raw & 0xC0) != 0x80) - 1
                    whole = np.bincount(of, ~gone) == 0
                    raw = raw[~whole[of]]
                texts.append(None if null else raw.tobytes().decode("utf-8", "replace"))
            own = dict(zip(others, b.column(0).flatten(), strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in own:
                counts = [n if t is None else len(t) for t, n in zip(texts, own["n_chars"].to_pylist(), strict=True)]
                own["n_chars"] = pa.array(counts, own["n_chars"].type)
            yield pa.RecordBatch.from_arrays([own[c] for c in schema.names], schema.names)

    # the other columns travel in one struct, so none of their names can clash
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("text").isNull().alias("no_text"), "doc_id", "text")
    marked = _with_marks(plain, ["others", "no_text"], length)
    return map_arrow(marked.select("others", "no_text", "tag", "packed", "marks"), run, schema)
