"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM to PCM.

The companded codes expand through 256-entry tables built by rule; ADPCM blocks
are decoded with numpy across blocks, one sample step for all blocks at a time.
Media are RIFF/WAVE files in a binary column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
# IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
BLOCK_BYTES = 64


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law code: complement, then (mantissa + bias) << exponent."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law code: even bits inverted, linear below segment 1."""
    code = np.arange(256) ^ 0x55
    segment, size = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, size + 8, size + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
# all (index, nibble) differences and next indices, so a step is two look-ups
_D = STEPS[:, None]
_N = np.arange(16)[None, :]
_SIZE = (_D >> 3) + np.where(_N & 1, _D >> 2, 0) + np.where(_N & 2, _D >> 1, 0) + np.where(_N & 4, _D, 0)
_CHANGE = np.where(_N & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + INDEX_CHANGE[None, :], 0, 88).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (n, bytes): int16 (n, 1 + 2 * (bytes - 4)).

    A block starts with its first sample (int16), the step index (held to 88)
    and a reserved byte; then come nibbles, low one first.
    """
    blocks = np.asarray(blocks, np.uint8)
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    for k in range(width - 4):
        for half, nibble in ((1, data[k] & 15), (2, data[k] >> 4)):
            at = (index << 4) + nibble
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            index = _NEXT[at]
            out[2 * k + half] = value
    return out.T


def encode_adpcm(pcm: np.ndarray, width: int = BLOCK_BYTES) -> np.ndarray:
    """Mono IMA ADPCM blocks of int16 samples; the last block repeats its last sample."""
    per = 1 + 2 * (width - 4)
    pcm = np.asarray(pcm, np.int32)
    if not len(pcm):
        return np.zeros((0, width), np.uint8)
    n = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1])]).reshape(n, per)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    nibbles = np.empty((n, per - 1), np.uint8)
    for k in range(1, per):
        table = value[:, None] + _CHANGE.reshape(89, 16)[index]
        best = np.abs(np.clip(table, -32768, 32767) - x[:, k : k + 1]).argmin(1)
        at = (index << 4) + best
        value, index = np.clip(value + _CHANGE[at], -32768, 32767), _NEXT[at]
        nibbles[:, k - 1] = best
    out = np.zeros((n, width), np.uint8)
    out[:, :2] = x[:, 0].astype("<i2")[:, None].view(np.uint8)
    out[:, 4:] = nibbles[:, 0::2] | nibbles[:, 1::2] << 4
    return out


def wave(data: bytes, tag: int = MULAW, rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file around stored samples."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(tag, 8)
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == IMA_ADPCM else struct.pack("<H", 0) if tag != PCM else b""
    per_s = rate * 2 if tag == PCM else rate if tag != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_s, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(tag, rate, block, stored samples) of a mono RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate, block, data = 12, 0, 0, 1, memoryview(b"")
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            data = memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return tag, rate, block, data


def decode_wave(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 PCM) of mu-law, A-law, IMA ADPCM or 16-bit PCM media."""
    tag, rate, block, data = parse_wave(media)
    raw = np.frombuffer(data, np.uint8)
    if tag in _TABLES:
        return rate, _TABLES[tag][raw]
    if tag == IMA_ADPCM:
        return rate, decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if tag == PCM:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"format tag {tag} is not telephony audio")


def _half_band(taps: int = 8) -> np.ndarray:
    k = np.arange(-taps + 0.5, taps)
    h = np.sinc(k) * np.cos(np.pi * k / (2 * taps)) ** 2
    return h / h.sum()


_BETWEEN = _half_band()


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and windowed-sinc values between them."""
    if not len(pcm):
        return pcm.astype(np.int16)
    side = len(_BETWEEN) // 2
    x = np.concatenate([np.zeros(side - 1), pcm, np.zeros(side)])
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(np.rint(np.convolve(x, _BETWEEN, "valid")), -32768, 32767)
    return out


def texts_as_audio(docs: DataFrame, unit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes as mu-law samples in a WAVE file.

    Null text counts as empty; zero bytes fill up to a positive multiple of
    ``unit``. The stored samples are the bytes themselves, so nothing is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                media = [wave(r + b"\0" * (max(unit, -(-len(r) // unit) * unit) - len(r))) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    schema = "doc_id bigint, n_bytes bigint, media binary"
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose values of one column take some ``most`` bytes; a part has a row at least."""
    ends = np.cumsum([0 if x is None else len(x) for x in (v.as_buffer() if v.is_valid else None for v in batch.column(column))])
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        take = max(1, int(np.searchsorted(ends[start:], before + most)))
        yield batch.slice(start, take)
        start += take


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace a column of WAVE media by ``pcm`` (16-bit little-endian) and ``rate``, resampled to twice the rate.

    Null media give null; other columns pass through.
    """
    from pyspark.sql import types as T

    keep = [f for f in media.schema.fields if f.name not in (column, "pcm", "rate")]
    schema = T.StructType([*keep, T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, pcm = [], []
            for m in batch.column(len(names)):
                if (m := m.as_py()) is None:
                    rates.append(None), pcm.append(None)
                else:
                    rate, x = decode_wave(m)
                    rates.append(2 * rate), pcm.append(resample_double(x).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rates, pa.int32()), pa.array(pcm, pa.binary())], [*names, "rate", "pcm"])

    return media.select(*[f"`{n}`" for n in names], column).mapInArrow(run, schema)


DIGEST = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string"
)


def media_features(media: DataFrame) -> DataFrame:
    """Digests of (doc_id, n_bytes, media) and a feature from the decoded samples.

    The feature holds, for the samples as mu-law, as A-law and as ADPCM blocks,
    the largest size and the mean square, and the CRC of the resampled mu-law
    PCM. ADPCM reads whole blocks only; without any its figures are 0, as those
    of media without samples. Null media give null digests and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                yield digest(part)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, codes, at = [], [], []
        for i, (doc_id, n, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
            m = m.as_py()
            if m is None:
                rows.append([doc_id, n, *[None] * 6])
                continue
            data = parse_wave(m)[3]
            codes.append(np.frombuffer(data, np.uint8))
            at.append(i)
            rows.append([doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK_BYTES:]), len(m), hashlib.sha256(m).hexdigest()])
        # the blocks of all media are decoded together
        blocks = [c[: len(c) // BLOCK_BYTES * BLOCK_BYTES].reshape(-1, BLOCK_BYTES) for c in codes]
        adpcm = decode_adpcm(np.concatenate([*blocks, np.zeros((0, BLOCK_BYTES), np.uint8)])).astype(np.int64)
        largest, squares = np.abs(adpcm).max(1), (adpcm * adpcm).sum(1)
        done = 0
        for i, c, b in zip(at, codes, blocks):
            parts = []
            for tag in (MULAW, ALAW):
                x = _TABLES[tag].astype(np.int64)[c]
                parts += [int(np.abs(x).max(initial=0)), int((x * x).sum()) // max(1, len(c))]
            own = slice(done, done + len(b))
            done += len(b)
            parts += [int(largest[own].max(initial=0)), int(squares[own].sum()) // max(1, len(b) * (1 + 2 * (BLOCK_BYTES - 4)))]
            up = resample_double(_TABLES[MULAW][c])
            rows[i].append("mulaw {} {} alaw {} {} adpcm {} {} pcm16k {}".format(*parts, zlib.crc32(up.astype("<i2").tobytes())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
