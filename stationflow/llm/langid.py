"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (up to ``ORDER`` bytes) with symbol
counts from labelled texts. The code length of a byte is exact under these frozen counts: in the
longest context it is -log2(count / (total + distinct)); a byte that a context has not seen pays
the escape -log2(distinct / (total + distinct)) and falls to the next shorter context, at last
to the uniform 8 bits. The language with the shortest code of the whole text wins.

Texts are lower-cased and every ASCII character that is not a letter reads as a space, so
capitals and symbols carry no language. Distinct (context, byte) pairs of a slice of texts are
priced once and summed back per text.

The counts are learnt from at most ``SAMPLE`` labelled documents per language and ``SAMPLE`` x
``LANGUAGES`` in all (the smallest hashes of doc_id; of rows that share an id and a language the
smallest text), so the model has a bounded size and is sent to the tasks whole.

Defined results: null text or no letter gives ``und`` with score 0; without any labelled
document every text is ``und``; ties go to the alphabetically first language; repeated rows give
repeated results; extra columns are ignored; very long texts are read whole; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_arrow, row_slices

ORDER, SAMPLE, LANGUAGES = 4, 250, 64
#: Bytes of text whose contexts are priced together.
SLICE = 4 << 20
_CLEAN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PAD = b" " * ORDER


def prepared(text: str | None) -> bytes:
    """Lower-cased UTF-8 with ASCII non-letters as single spaces; empty if the text has no letter."""
    if not text:
        return b""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split())
    if raw.strip(bytes(range(128, 256)) + b" ") or any(map(str.isalpha, text)):
        return _PAD + raw + b" "
    return b""


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte key of every byte after each text's padding, and where each text's keys start."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    keys = np.zeros(max(0, len(raw) - ORDER), np.int64)
    for i in range(ORDER + 1):
        keys = keys << 8 | raw[i : len(raw) - ORDER + i]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    keep = np.ones(len(keys), bool)
    for end in ends[:-1]:
        keep[end - ORDER : end] = False
    return keys[keep], np.concatenate([[0], np.cumsum(np.maximum(lengths - ORDER, 0))])


class Model:
    """Frozen counts of every language as sorted arrays per order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.trees = [self._tree(*counts[x]) for x in self.languages]

    @staticmethod
    def _tree(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        tree = []
        for order in range(ORDER + 1):
            own, at = np.unique(keys & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            count = np.bincount(at, n)
            contexts, of = np.unique(own >> 8, return_inverse=True)
            total, distinct = np.bincount(of, count), np.bincount(of)
            tree.append((own, -np.log2(count / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct))))
        return tree

    def prices(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of each (context, byte) key, one row per language."""
        out = np.zeros((len(self.languages), len(keys)))
        for row, tree in zip(out, self.trees, strict=True):
            rest = np.arange(len(keys))
            for order in range(ORDER, -1, -1):
                own, bits, contexts, escapes = tree[order]
                key = keys[rest] & (1 << 8 * (order + 1)) - 1
                at = np.minimum(np.searchsorted(own, key), len(own) - 1)
                seen = own[at] == key
                row[rest[seen]] += bits[at[seen]]
                rest, key = rest[~seen], key[~seen] >> 8
                at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
                known = contexts[at] == key
                row[rest[known]] += escapes[at[known]]
            row[rest] += 8
        return out

    def classify(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language or -1, its share of the posterior) of each prepared text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        full = [i for i, t in enumerate(texts) if t]
        if not full or not self.languages:
            return best, score
        keys, starts = gram_keys([texts[i] for i in full])
        coded = pa.array(keys).dictionary_encode()
        prices = self.prices(coded.dictionary.to_numpy()).astype(np.float32)
        at = coded.indices.to_numpy()
        bits = np.array([np.add.reduceat(row[at], starts[:-1], dtype=np.float64) for row in prices])
        best[full] = bits.argmin(0)
        score[full] = 1 / np.exp2(np.clip(bits.min(0) - bits, -1000, 0)).sum(0)
        return best, score


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts from at most ``sample`` labelled documents per language that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang")
    chosen = bounded_sample(labelled, "lang", sample).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample * LANGUAGES)
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x := prepared(text):
                    by.setdefault(lang, []).append(x)
            for lang, found in by.items():
                keys, n = np.unique(gram_keys(found)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())], ["lang", "key", "n"])

    counts = map_arrow(texts, count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pandas()
    return Model({lang: (x["key"].to_numpy(), x["n"].to_numpy()) for lang, x in found.groupby("lang")})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits per byte of the best code, one row per document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        names = np.array([*own.languages, "und"], object)
        for b in batches:
            texts = [prepared(x) for x in b.column(2).to_pylist()]
            best, score = [], []
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
            for i, j in row_slices(offsets, SLICE):
                a, s = own.classify(texts[i:j])
                best.append(a)
                score.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(names[np.concatenate([np.zeros(0, int), *best]).astype(int)], pa.string()), pa.array(np.concatenate([np.zeros(0), *score]))], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double")
