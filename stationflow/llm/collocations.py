"""Phrase collocation mining over a prefix-free parse.

Texts are cut into pieces at punctuation and line ends, and pieces into chunks by content: a chunk ends
where the hash of three words in a row is divisible by ``TRIGGER``, and the next one begins with those three
words. So chunks of a piece overlap by three words, no chunk is a prefix of another, and equal stretches
of text give equal chunks wherever they stand. The distinct chunks of each language with their frequencies
are the dictionary: copies, repeated lines and frequent sentences are counted once, times their frequency.

N-grams are counted inside the distinct chunks only, weighted by frequency. A chunk owns the n-grams that
start before its last three words (all of them if it ends its piece), so each occurrence in a text is
counted in exactly one chunk and n-grams of up to four words never leave it. Lengths are counted one after
another: an n-gram is counted only if both its parts of one word less are frequent. Which ones are is told
by a bitmap of fixed size (``FILTER_BITS``) that is broadcast; where it fills up it prunes less, and the
counts stay exact, since what it lets pass is counted by its words and cut at the least frequency.

Defined results: null texts are empty; a null language is ``und``; very long texts and pieces are read
whole (a piece without a trigger is one chunk); repeated rows count as often as they are there; ties are
broken by phrase; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, row_slices, stored, text_buffers
from .words import document_tokens, fold, gather, mix

#: Words that chunks overlap by, and one in how many places ends a chunk.
OVERLAP, TRIGGER = 3, 16
LONGEST = OVERLAP + 1
FILTER_BITS = 1 << 27
#: Bytes of text or chunks that are counted together.
COUNTED = 8 << 20
#: Parts in which the best of a language are ranked first.
PARTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = _BREAK[10:14] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
_SPACE = np.zeros(256, bool)
_SPACE[32] = True


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunk's words joined by spaces, it ends its piece, document) of every chunk of some texts."""
    lower, start, end, hashes, first = document_tokens(raw, offsets, _APART)
    n = len(start)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.cumsum(_BREAK[lower])[start] if n else start
    opens = np.ones(n, bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    piece = np.cumsum(opens)
    cut = opens.copy()
    if n >= OVERLAP:
        cut[: n - OVERLAP + 1] |= (fold(hashes, OVERLAP) % np.uint64(TRIGGER) == 0) & (piece[: n - OVERLAP + 1] == piece[OVERLAP - 1 :])
    at = np.flatnonzero(cut)
    following = np.append(at[1:], n)
    last = np.append(opens[at[1:]], True) if len(at) else np.zeros(0, bool)
    upto = np.where(last, following, following + OVERLAP)
    # the words with one space after each
    sizes = end - start
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(place[-1], 32, np.uint8)
    joined[np.arange(sizes.sum()) + np.repeat(np.arange(n), sizes)] = lower[~_APART[lower]]
    return gather(joined, place[at], place[upto] - 1), last, doc[at]


def parse(batches) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of stretches of (lang, text), counted."""
    for b in batches:
        raw, offsets = text_buffers(b.column(1))
        for i, j in row_slices(offsets, COUNTED):
            found, last, doc = chunks(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            t = pa.table({"lang": b.column(0).slice(i, j - i).take(pa.array(doc)), "chunk": found.cast(pa.large_string()), "last": pa.array(last), "n": pa.array(np.ones(len(last), np.int64))})
            t = t.group_by(["lang", "chunk", "last"], use_threads=False).aggregate([("n", "sum")])
            yield from pa.table([t["lang"], t["chunk"].cast(pa.string()), t["last"], t["n_sum"]], ["lang", "chunk", "last", "n"]).to_batches()


def _gathered(batches, size: int = COUNTED) -> Iterator[pa.Table]:
    """Batches of chunks put together to about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _slots(hashes: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """The bit of the n words from each place on, given the hash of the language there."""
    h = fold(hashes, n)
    with np.errstate(over="ignore"):
        return (mix(h + lang[: len(h)]) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _language_hashes(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)


def count_phrases(batches, k: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the k-grams that the distinct chunks own and whose parts may be frequent, weighted."""
    for t in _gathered(batches):
        lang = t["lang"].combine_chunks().dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)
        raw, offsets = text_buffers(t["chunk"].combine_chunks())
        lower, start, end, hashes, first = document_tokens(raw, offsets, _SPACE)
        sizes = np.diff(first)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(first[1:], sizes) - np.arange(len(start))  # words from here to the chunk's end
        last, weight = t["last"].to_numpy().astype(bool), t["n"].to_numpy()
        owned = left > np.where(last, 0, OVERLAP)[chunk]
        wanted = owned & (left >= k)
        if bitmap is not None:
            slots = _slots(hashes, k - 1, _language_hashes(names)[code][chunk])
            hot = np.zeros(len(start) + 1, bool)
            hot[: len(slots)] = bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 == 1
            wanted &= hot[:-1] & hot[1:]
        at = np.flatnonzero(wanted)
        if not len(at):
            continue
        words = gather(lower, start, end).dictionary_encode()
        word = words.indices.to_numpy().astype(np.int64)
        # numbers of equal phrases, a word at a time, starting from the language
        number = code[chunk[at]]
        for j in range(k):
            _, some, number = np.unique(number * len(words.dictionary) + word[at + j], return_index=True, return_inverse=True)
        n = np.bincount(number, weight[chunk[at]]).astype(np.int64)
        example = at[some]
        phrases = gather(lower, start[example], end[example + k - 1]).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code[chunk[example]])), phrases, pa.array(n)], ["lang", "phrase", "n"])


def _bitmap(frequent: DataFrame, k: int) -> np.ndarray:
    """The slots of the frequent phrases of k words; ``FILTER_BITS`` bits however many there are."""

    def run(batches):
        for t in _gathered(batches):
            lang = t["lang"].combine_chunks().dictionary_encode()
            raw, offsets = text_buffers(t["phrase"].combine_chunks())
            _, _, _, hashes, first = document_tokens(raw, offsets, _SPACE)
            of = _language_hashes(lang.dictionary.to_pylist())[lang.indices.to_numpy()]
            slots = _slots(hashes, k, np.repeat(of, np.diff(first)))[first[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    slots = map_arrow(frequent.select("lang", "phrase"), run, "slot bigint")
    found = slots.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of each language and how often the parse has them."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return map_arrow(texts, parse, "lang string, chunk string, last boolean, n bigint").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def frequent_phrases(chunked: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f) of the phrases of up to four words that occur ``least`` times or more."""
    spark, out, bitmap = chunked.sparkSession, None, None
    for k in range(1, LONGEST + 1):
        sent = spark.sparkContext.broadcast(bitmap)
        parts = map_arrow(chunked, lambda x, sent=sent, k=k: count_phrases(x, k, sent.value), "lang string, phrase string, n bigint")
        found = stored(parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"))
        sent.destroy()
        out = found if out is None else out.unionByName(found)
        if k < LONGEST:
            bitmap = _bitmap(found, k)
    return out


def _words_of(phrase: str, start, size) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def _wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def mine(docs: DataFrame, least: int = 30, overlap: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to 4 words.

    ``least``: occurrences of a candidate; ``overlap``: per cent of a candidate's occurrences at which a
    longer candidate around it replaces it.
    """
    chunked = stored(dictionary(docs))
    words = F.size(F.split("chunk", " ")) - F.when(F.col("last"), 0).otherwise(OVERLAP)
    totals = chunked.groupBy("lang").agg(F.sum(words * F.col("n")).alias("n"))
    every = frequent_phrases(chunked, least)
    candidates = every.where("k >= 2").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"x": _words_of("phrase", 1, F.col("cut")), "y": _words_of("phrase", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    side = lambda key, name: every.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(side("x", "l"), ["lang", "x"]).join(side("y", "r"), ["lang", "y"])
    value = F.expr("CAST(CAST(a AS DECIMAL(20,0)) * 2000000 AS DECIMAL(38,0)) div CAST(l + r AS DECIMAL(20,0))")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(value.alias("score"), "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, size), " "))))
    around = candidates.where("k > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(_wide(F.col("longer")) * 100 < _wide(F.col("a")) * overlap, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
