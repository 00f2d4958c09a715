"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks.

Stored forms are WAVE files. Companded samples expand through 256-entry tables; ADPCM
blocks are independent, so one numpy step decodes the same nibble of all blocks at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the WAVE format.
MULAW, ALAW, IMA = 7, 6, 17
#: Payload bytes come in whole frames of this many, filled up with PAD.
FRAME, PAD, RATE = 576, b"\xff", 8000
#: Bytes of one ADPCM block, of which four are its header.
BLOCK = 64
#: Bytes of payload that are decoded together.
TOGETHER = 1 << 20


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code: codes are stored inverted, with sign, exponent and mantissa."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code: even bits are stored inverted, and a set sign bit is positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    power, base = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(power == 0, base, (base + 256) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


# Fixed values of the IMA ADPCM format: step sizes by index, and how a code moves the index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)

MU, A = mulaw_table(), alaw_table()


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, code): the signed difference and the next index."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[None, :], 0, len(STEPS) - 1)
    return np.where(code & 8, -diff, diff).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


DIFFS, NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode mono IMA ADPCM: one row of bytes per block in, one row of PCM per block out.

    A block starts with its first sample (16 bits) and its step index (clipped to the
    table); each byte after the header holds two codes, the low one first.
    """
    blocks = np.asarray(blocks, dtype=np.uint8)
    last = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    codes = np.empty((2 * data.shape[0], data.shape[1]), dtype=np.uint8)
    codes[0::2], codes[1::2] = data & 15, data >> 4
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = last
    for k, code in enumerate(codes):
        at = state + code
        last = np.clip(last + DIFFS[at], -32768, 32767)
        state = NEXT[at]
        out[k + 1] = last
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation of int16 samples to another rate; n samples give n * to / rate,
    rounded up. Doubling the rate, the usual case, takes integer means of neighbours."""
    if to == rate or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.repeat(pcm, 2)
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        return out
    at = np.arange(-(-len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wave(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A WAVE file that holds the payload as it is: 8-bit companded samples or ADPCM blocks."""
    if codec == IMA:
        per_block = (BLOCK - 4) * 2 + 1
        fmt = struct.pack("<HHIIHHHH", codec, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        fmt = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, payload) of a WAVE file; ValueError if it isn't a whole one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or len(media) < 8 + struct.unpack("<I", media[4:8])[0]:
        raise ValueError("not a whole WAVE file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack("<HHI", media[at + 8 : at + 16])
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in WAVE file")


def expand(payload: bytes, codec: int) -> np.ndarray:
    """PCM samples of a payload: a table lookup, or ADPCM blocks decoded together."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == MULAW:
        return MU[raw]
    if codec == ALAW:
        return A[raw]
    if codec == IMA:
        return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    raise ValueError(f"codec {codec}")


def measures(pcm: np.ndarray) -> str:
    """Samples, peak, energy and sign changes of PCM, as text."""
    wide = pcm.astype(np.int64)
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};energy={int((wide * wide).sum())};zc={int(np.count_nonzero((pcm[1:] ^ pcm[:-1]) < 0))}"


def codec_of(payload: bytes) -> int:
    """Which stored form a payload takes: its checksum picks one of the three."""
    return (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]


def store(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its WAVE file): UTF-8 filled up to a positive multiple of FRAME."""
    data = (text or "").encode("utf-8", "surrogatepass")
    payload = data + PAD * (-len(data) % FRAME if data else FRAME)
    return len(data), wave(payload, codec_of(payload))


def _adpcm_together(payloads: list[bytes]) -> list[np.ndarray]:
    """Decode the blocks of several payloads in runs of about TOGETHER bytes."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0
    for k, payload in enumerate(payloads):
        run.append(payload)
        size += len(payload)
        if size >= TOGETHER or k == len(payloads) - 1:
            raw = np.frombuffer(b"".join(run), dtype=np.uint8).reshape(-1, BLOCK)
            pcm = decode_adpcm(raw)
            at = 0
            for x in run:
                out.append(pcm[at : at + len(x) // BLOCK].ravel())
                at += len(x) // BLOCK
            run, size = [], 0
    return out


def media_rows(docs: DataFrame, to_rate: int = 16000, keep: bool = True) -> DataFrame:
    """Store every text as telephony audio, read it back, and decode it to resampled PCM.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pcm_sha256 and, with ``keep``, the columns media and pcm
    themselves. One row per input row; null counts as empty text, which is one frame of
    padding; equal texts give equal values; extra columns are left out. Texts are handled
    whole, one after the other, so memory follows the longest text of a task.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_sha256", pa.string())]
    fields += [("media", pa.binary()), ("pcm", pa.binary())] if keep else []
    schema = pa.schema(fields)

    def rows(batch: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
        ids, made = [], []
        for i in range(start, stop):
            ids.append(batch.column(0)[i].as_py())
            made.append(store(batch.column(1)[i].as_py()))
        back = [parse_wave(media) for _, media in made]
        blocks = iter(_adpcm_together([p for c, _, p in back if c == IMA]))
        columns: list[list] = [[] for _ in fields]
        for doc_id, (n, media), (codec, rate, payload) in zip(ids, made, back, strict=True):
            pcm = next(blocks) if codec == IMA else expand(payload, codec)
            out = resample(pcm, rate, to_rate).astype("<i2").tobytes()
            feature = f"codec={codec};rate={rate};{measures(pcm)}"
            row = [doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, hashlib.sha256(out).hexdigest()]
            for column, value in zip(columns, row + [media, out] * keep, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f[1]) for c, f in zip(columns, fields, strict=True)], schema=schema)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            for i in range(batch.num_rows):
                size += len(batch.column(1)[i].as_py() or "")
                if size >= 4 * TOGETHER or i == batch.num_rows - 1:
                    yield rows(batch, start, i + 1)
                    start, size = i + 1, 0

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(convert, ", ".join(f"{n} {names[t]}" for n, t in fields))


def store_media(docs: DataFrame, path: str, to_rate: int = 16000) -> DataFrame:
    """Write the rows of ``media_rows``, WAVE files and resampled PCM included, to ``path``, and
    read them back. PCM at twice the rate is four times the size of companded text."""
    rows = media_rows(docs, to_rate, keep=True)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
