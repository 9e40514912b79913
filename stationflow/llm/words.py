"""Word and shingle hashes of whole slices of text, in numpy.

A word's 64-bit hash is a polynomial over its bytes taken from running sums, then mixed; a
shingle's hash folds its words in order. The same text always gives the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Lower-cases A-Z.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: Bytes that part words: white space only, or everything but ASCII letters, digits and non-ASCII bytes.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_M, pow(_M, -1, 1 << 64))):
                steps = np.full(max(n, 1 << 20), base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of lower-cased bytes; ``apart`` marks the bytes between words."""
    edge = np.flatnonzero(np.diff(apart.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        summed = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=summed[1:])
        return start, end, mix((summed[end] - summed[start]) * down[start])


def document_tokens(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end and hash of every word, index of each document's first word); words never cross documents."""
    lower = LOWER[raw]
    gap = apart[raw]
    # where two documents' words touch, a separator goes between them
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    joined = borders[~gap[borders - 1] & ~gap[borders]] if len(borders) else borders
    if len(joined):
        lower = np.insert(lower, joined, 32)
        gap = np.insert(gap, joined, True)
        offsets = offsets + np.searchsorted(joined, offsets, side="left")
    start, end, hashes = word_hashes(lower, gap)
    return lower, start, end, hashes, np.searchsorted(start, offsets)


def document_words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each document's first word); words never cross documents."""
    return document_tokens(raw, offsets, apart)[3:]


def gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of some bytes as strings."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = raw[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words, whatever documents they are in."""
    size = max(0, len(words) - n + 1)
    h = np.full(size, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : size + i])
    return h


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-word shingle; a document with 1 to n - 1 words has its whole sequence as one."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    h = fold(words, n)
    whole = doc[: len(h)] == doc[n - 1 :][: len(h)]
    h, of = h[whole], doc[: len(h)][whole]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            h, of = np.concatenate([h, fold(words, size)[first[short]]]), np.concatenate([of, short])
    order = np.argsort(of, kind="stable")
    return h[order], of[order]
