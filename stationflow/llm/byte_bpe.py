"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The rank vocabulary becomes a sentencepiece BPE model in memory: every piece is written with one
character per byte, its score is its negative rank, and normalisation is the identity. The best
score merges first and the leftmost of equals, which is the rank order. Texts are split by the
public pattern; each distinct pre-token is encoded once per task's cache. A pre-token that is
itself a vocabulary entry takes that id, as rank-based encoders do. Decoding inverts the mapping:
the model's pieces are turned from characters back into bytes, and ids gather these.

Defined results: null reads as empty (no ids); very long texts are encoded whole; repeated rows
give repeated results; extra columns are kept by ``encode_texts`` (but for one named ``token_ids``,
which it replaces) and ignored by ``token_digests``; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_arrow, row_slices

#: Pre-tokens that a task keeps encoded; a full cache starts anew.
CACHE = 400_000
#: Characters of text whose new pre-tokens are encoded in one call.
TOGETHER = 400_000
#: Where the byte-wise alphabet starts: bytes map to printable characters of the Latin and Latin Extended blocks.
_OTHER = 0x100


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else the next free one from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(_OTHER, _OTHER + 256))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must be 0, 1, 2, ... without holes."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(bytes.strip, f))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a rank vocabulary; its ids are the ranks, with one unknown piece after them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(chars[b] for b in token), -float(rank), pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    n = model.normalizer_spec
    n.name, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", b"", False, False, False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes with one model; lives in a task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.whole = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        # the inverse mapping, from the model's own pieces: characters back to bytes
        pieces = [self.model.id_to_piece(i) for i in range(len(tokens))]
        inverse = {ord(c): b for b, c in self.table.items()}
        lengths = np.array([len(x) for x in pieces], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.bytes = np.frombuffer("".join(pieces).translate(inverse).encode("latin-1"), np.uint8)

    def _learn(self, missing: list[str]) -> None:
        raw = [x.encode() for x in missing]
        rest = []
        for x, b in zip(missing, raw, strict=True):
            i = self.whole.get(b)
            if i is None:
                rest.append((x, b.decode("latin-1").translate(self.table)))
            else:
                self.known[x] = i.to_bytes(4, "little")
        if rest:
            encoded = self.model.encode([x for _, x in rest], num_threads=1)
            self.known.update((x, array("I", ids).tobytes()) for (x, _), ids in zip(rest, encoded, strict=True))

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; new pre-tokens of a few texts at a time are encoded together."""
        for i, j in row_slices(np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]), TOGETHER):
            parts = [self.split(x) for x in texts[i:j]]
            if len(self.known) > CACHE:
                self.known.clear()
            self._learn([*set().union(*parts).difference(self.known)])
            get = self.known.__getitem__
            for x in parts:
                yield np.frombuffer(b"".join(map(get, x)), "<u4")

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces' bytes, gathered from one buffer of the whole model."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def _codec_of(path: str, pattern: str):
    tokens = load_ranks(path)
    return tokens, serialise(tokens), pattern


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``token_ids`` added: the ids of each whole text."""
    parts, columns = _codec_of(path, pattern), [c for c in docs.columns if c != "token_ids"]
    at = columns.index("text")

    def run(batches):
        codec = Codec(*parts)
        for b in batches:
            ids = [*codec.encode_many([x or "" for x in b.column(at).to_pylist()])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [*columns, "token_ids"])

    schema = docs.select(columns).schema.add("token_ids", ArrayType(IntegerType()))
    return map_arrow(docs.select(columns), run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the text's bytes, one row per document."""
    parts = _codec_of(path, pattern)

    def run(batches):
        codec = Codec(*parts)
        for b in batches:
            n, ids_sha, text_sha, size = [], [], [], []
            for ids in codec.encode_many([x or "" for x in b.column(1).to_pylist()]):
                back = codec.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                size.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
