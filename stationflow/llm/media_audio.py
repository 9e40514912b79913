"""Media columns: telephony audio.

Payload bytes are stored as telephony audio in a WAVE container: as mu-law or A-law samples (one byte
a sample) or as IMA ADPCM blocks (``UNIT`` bytes each), by the payload's own checksum, so equal
payloads are stored alike and every coding carries its share. Storing is lossless in all three:
the coded bytes are the payload. Reading expands mu-law and A-law by 256-entry lookup tables built
from the coding rule, decodes the ADPCM blocks of a whole batch with numpy at once (a step of the
recurrence handles one sample of every block), resamples, and stores the result as 16-bit PCM in
another WAVE column, from which the features are read.

Defined results: null reads as an empty payload; a payload is padded with byte 255 to a positive
multiple of ``UNIT``; equal payloads give equal values; very long texts are stored whole; extra
columns are ignored by ``store_texts`` and ``features`` and kept by ``to_pcm`` (but for one named
``pcm_wave``, which it replaces); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import byte_lists, map_arrow, row_slices

UNIT, RATE, TARGET_RATE = 576, 8000, 16000
#: Coded bytes that are decoded together.
TOGETHER = 4 << 20
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 0x11

# Fixed values of the IMA ADPCM coding: step sizes and index moves.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: sign, 3-bit exponent, 4-bit mantissa, all inverted, bias 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype("<i2")


def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, sign, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, size + 8, size + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype("<i2")


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks (16-bit first sample, index, pad, then nibbles, low first) to 16-bit PCM."""
    blocks = data[: len(data) // block * block].reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), 2 * (block - 4)).astype(np.int32)
    out = np.empty((len(blocks), nibbles.shape[1] + 1), "<i2")
    out[:, 0] = value
    for i in range(nibbles.shape[1]):
        code, step = nibbles[:, i], STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, i + 1] = value
    return out.reshape(-1)


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation on exact rational positions; integer arithmetic, so equal inputs give equal bytes."""
    if not len(pcm) or source == target:
        return pcm.astype("<i2")
    at = np.arange((len(pcm) * target + source - 1) // source, dtype=np.int64) * source
    left, part = at // target, at % target
    x = pcm.astype(np.int64)
    right = np.minimum(left + 1, len(x) - 1)
    return ((x[left] * (target - part) + x[right] * part) // target).astype("<i2")


def wave(data: bytes, coding: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAVE file of the given coding."""
    per_block = 2 * (block - 4) + 1 if coding == IMA_ADPCM else 1  # samples
    extra = struct.pack("<HH", 2, per_block) if coding == IMA_ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", coding, 1, rate, rate * block // per_block, block, bits) + extra
    fact = struct.pack("<I", len(data) // max(1, block) * per_block)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact\4\0\0\0" + fact + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(coding, rate, block size, data) of a WAVE file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("a WAVE file needs a format and data")
    return form[0], form[2], form[4], data


def expand(media: list[bytes | None]) -> list[tuple[np.ndarray, int] | None]:
    """16-bit PCM and its rate of each WAVE file, by the file's coding; the ADPCM blocks of all files are decoded together."""
    out: list[tuple[np.ndarray, int] | None] = []
    later: dict[int, list[int]] = {}
    raws: dict[int, np.ndarray] = {}
    for i, x in enumerate(media):
        if x is None:
            out.append(None)
            continue
        coding, rate, block, data = read_wave(x)
        raw = np.frombuffer(data, np.uint8)
        if coding == MU_LAW:
            pcm = MU_TABLE[raw]
        elif coding == A_LAW:
            pcm = A_TABLE[raw]
        elif coding == IMA_ADPCM:
            later.setdefault(block, []).append(i)
            pcm, raws[i] = raw, raw[: len(raw) // block * block]
        elif coding == PCM and block == 2:
            pcm = np.frombuffer(data, "<i2")
        else:
            raise ValueError(f"coding {coding} is not supported")
        out.append((pcm, rate))
    for block, which in later.items():
        for low, high in row_slices(np.concatenate([[0], np.cumsum([len(raws[i]) for i in which])]), TOGETHER):
            pcm = decode_adpcm(np.concatenate([raws[i] for i in which[low:high]]), block)
            sizes = np.array([len(raws[i]) // block for i in which[low:high]]) * (2 * (block - 4) + 1)
            for i, own in zip(which[low:high], np.split(pcm, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = own, out[i][1]
    return out


def _with_pcm(columns: list[str], media: str, rate: int):
    at = columns.index(media)

    def run(batches):
        for b in batches:
            # a few rows at a time: the PCM is several times as long as what it comes from
            sizes = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in b.column(at).to_pylist()])])
            for low, high in row_slices(sizes, TOGETHER):
                part = b.slice(low, high - low)
                found = expand(part.column(at).to_pylist())
                out = [None if x is None else wave(resample(*x, rate).tobytes(), PCM, rate, 16, 2) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*columns, "pcm_wave"])

    return run


def to_pcm(df: DataFrame, media: str = "media", rate: int = TARGET_RATE) -> DataFrame:
    """``df`` with ``pcm_wave``: the column's audio as resampled 16-bit PCM; null stays null."""
    columns = [c for c in df.columns if c != "pcm_wave"]
    own = df.select(*[F.col(f"`{c}`") for c in columns])
    return map_arrow(own, _with_pcm(columns, media, rate), StructType([*own.schema.fields, StructField("pcm_wave", BinaryType())]))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def stored_as(payload: bytes) -> bytes:
    """The payload as a WAVE file, in the coding that its checksum names."""
    coding = (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    return wave(payload, coding, RATE, 4, UNIT) if coding == IMA_ADPCM else wave(payload, coding)


def _stored(batches):
    for b in batches:
        raw = byte_lists(b.column(1))
        for low, high in row_slices(np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]), TOGETHER):
            part = raw[low:high]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low).cast(pa.int64()), pa.array([len(x) for x in part], pa.int64()), pa.array([stored_as(padded(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's payload as a WAVE file."""
    return map_arrow(docs.select("doc_id", "text"), _stored, "doc_id bigint, n_bytes bigint, media binary")


def described(media: bytes, pcm_wave: bytes) -> str:
    """The feature text, from the stored PCM and the media's coding."""
    coding = read_wave(media)[0]
    _, rate, _, data = read_wave(pcm_wave)
    wide = np.frombuffer(data, "<i2").astype(np.int64)
    rms = int(np.sqrt(np.dot(wide, wide) / len(wide)))
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"coding={coding};rate={rate};samples={len(wide)};rms={rms};peak={int(np.abs(wide).max())};crossings={crossings};pcm_crc32={zlib.crc32(data):08x}"


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_bytes bigint"


def _described(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        rows = []
        for doc_id, n, media, pcm in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            payload = read_wave(media)[3]
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(media, pcm), len(read_wave(pcm)[3])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def features(stored: DataFrame) -> DataFrame:
    """The contract's row per document and the PCM's size, from the stored bytes alone (``media`` and ``pcm_wave``)."""
    return map_arrow(stored.select("doc_id", "n_bytes", "media", "pcm_wave"), _described, _FEATURES)


def text_features(docs: DataFrame) -> DataFrame:
    """``features(to_pcm(store_texts(docs)))`` in one pass: the columns go from step to step a few rows at a time and stay in the task."""
    pcm = _with_pcm(["doc_id", "n_bytes", "media"], "media", TARGET_RATE)
    return map_arrow(docs.select("doc_id", "text"), lambda batches: _described(pcm(_stored(batches))), _FEATURES)
