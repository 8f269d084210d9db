"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM, mono, in WAV containers.

`store` writes 8-bit payloads as the sample codes of a WAV: one code for each byte (mu-law, A-law), or two 4-bit
codes in each byte (ADPCM, in blocks of 192 bytes behind a zeroed 4-byte header). `expand` reads such a column
back, expands G.711 codes by lookup tables, decodes all ADPCM blocks of a batch side by side (one numpy step for each
nibble position), and resamples to 16-bit PCM with a windowed-sinc polyphase filter.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import common

#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
RATE, BLOCK = 8000, 192
#: Fixed values of IMA ADPCM: quantizer steps, and index moves by the code's magnitude.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
    598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
    13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


@cache
def g711_table(codec: str) -> np.ndarray:
    """The 256 linear 16-bit values of mu-law or A-law codes, by G.711's segment rule."""
    code = np.arange(256)
    if codec == "mulaw":
        c = code ^ 0xFF
        size = (((c & 15) << 3) + 0x84 << (c >> 4 & 7)) - 0x84
        return np.where(c & 0x80, -size, size).astype(np.int16)
    c = code ^ 0x55
    segment = c >> 4 & 7
    size = np.where(segment == 0, ((c & 15) << 4) + 8, ((c & 15) << 4) + 0x108 << np.maximum(segment - 1, 0))
    return np.where(c & 0x80, size, -size).astype(np.int16)


@cache
def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index, by 16 * index + code."""
    step, code = np.meshgrid(np.array(STEPS), np.arange(16), indexing="ij")
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    moved = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[np.arange(16) & 7][None, :], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (16 * moved).astype(np.int32).ravel()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) uint8 with 4-byte headers to (blocks, samples) int16: the header's sample, then one for each nibble."""
    diff, after = adpcm_tables()
    head = np.ascontiguousarray(blocks[:, :4])
    level = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = 16 * np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = level
    for t, byte in enumerate(codes):
        for half, nibble in ((1, byte & 15), (2, byte >> 4)):
            at = index + nibble
            level = np.clip(level + diff[at], -32768, 32767)
            index = after[at]
            out[2 * t + half] = level
    return np.ascontiguousarray(out.T)


@cache
def _filters(up: int, down: int, taps: int = 16) -> np.ndarray:
    cut = min(1.0, up / down)
    at = np.arange(taps) - taps // 2 + 1
    rows = [cut * np.sinc(cut * (at - p / up)) * np.kaiser(2 * taps * up + 1, 8.0)[np.clip((taps * up + (at - p / up) * 2 * up).astype(int), 0, 2 * taps * up)] for p in range(up)]
    return np.array([r / r.sum() for r in rows])


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """int16 samples at `to` Hz: ceil(n * to / rate) of them, by a 16-tap polyphase filter."""
    if rate == to or not len(pcm):
        return pcm
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    filters, n = _filters(up, down).astype(np.float32), -(-len(pcm) * up // down)
    taps = filters.shape[1]
    padded = np.concatenate([np.zeros(taps // 2 - 1, np.float32), pcm.astype(np.float32), np.zeros(taps // 2 + 1, np.float32)])
    around = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, dtype=np.float32)
    for lo in range(0, n, 65536):
        at = np.arange(lo, min(n, lo + 65536)) * down
        part = out[lo : lo + 65536]
        for first in range(min(up, len(part))) if up <= 16 else ():  # few phases: one product each
            where = at[first::up]
            phase = int(where[0] % up)
            part[first::up] = padded[where // up + taps // 2 - 1] if phase == 0 and up >= down else around[where // up] @ filters[phase]
        if up > 16:
            part[:] = np.einsum("ij,ij->i", around[at // up], filters[at % up])
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """The payload, a multiple of 192 bytes, as the sample codes of a WAV."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // BLOCK, BLOCK + 4), dtype=np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
        data, align, bits, extra = blocks.tobytes(), BLOCK + 4, 4, struct.pack("<HH", 2, 2 * BLOCK + 1)
        samples = len(blocks) * (2 * BLOCK + 1)
    else:
        data, align, bits, extra, samples = payload, 1, 8, struct.pack("<H", 0), len(payload)
    per_s = rate * align // (2 * BLOCK + 1) if codec == "adpcm" else rate
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_s, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block align and data of a WAV; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, codec, rate, align = 12, "", 0, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag, "")
        elif name == b"data" and codec:
            return codec, rate, align, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no telephony codec or no data")


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a WAV column `media` of each text; the payload's crc32 picks one of the three codecs.

    Null text is empty, one block of spaces. Null ids and repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = [pad(t.as_py()) for t in batch.column(1)[lo : lo + 512]]
                media = [wav(CODECS[zlib.crc32(p) % 3], p) for _, p in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 512], pa.array([n for n, _ in rows], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(common.arrow_map, run, "doc_id long, n_bytes long, media binary")


def decode_batch(media: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[tuple[str, int]]]:
    """Payloads, 16-bit samples at the stored rate, and (codec, rate); ADPCM blocks of all files are decoded together."""
    parsed = [chunks(m) for m in media]
    payloads, pcm, waiting = [b""] * len(media), [np.zeros(0, np.int16)] * len(media), {}
    for i, (codec, _, align, data) in enumerate(parsed):
        if codec == "adpcm":
            blocks = np.frombuffer(data, dtype=np.uint8).reshape(-1, align)
            payloads[i] = np.ascontiguousarray(blocks[:, 4:]).tobytes()
            waiting.setdefault(align, []).append((i, blocks))
        else:
            payloads[i] = data
            pcm[i] = g711_table(codec)[np.frombuffer(data, dtype=np.uint8)]
    for rows in waiting.values():
        at, stack = 0, np.concatenate([b for _, b in rows])
        done = np.concatenate([adpcm_decode(stack[lo : lo + 8192]) for lo in range(0, len(stack), 8192)])
        for i, blocks in rows:
            pcm[i] = done[at : at + len(blocks)].ravel()
            at += len(blocks)
    return payloads, pcm, [(p[0], p[1]) for p in parsed]


def expand(media: DataFrame, rate: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """What the stored bytes give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, n_samples, feature, pcm.

    media is what `store` made (doc_id, n_bytes, media). Null ids and repeated rows stay, other columns are not read, an empty table
    gives no rows; a null or broken container is an error. pcm holds 16-bit little-endian samples at `rate`; with keep_pcm=False it is dropped once the feature is made.
    The feature names the codec, sample count, root mean square, zero crossings and crc32 of the resampled PCM.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "n_samples", "feature", "pcm"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                blobs = part.column(2).to_pylist()
                payloads, samples, forms = decode_batch(blobs)
                rows = []
                for d, n, blob, payload, x, (codec, stored) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs, payloads, samples, forms, strict=True):
                    y = resample(x, stored, rate)
                    raw = y.tobytes()
                    f = y.astype(np.float64)
                    feature = f"{codec}|{rate}|{len(y)}|{math.sqrt(float(f @ f) / max(1, len(y))):.3f}|{np.count_nonzero(np.diff(y < 0))}|{zlib.crc32(raw)}"
                    rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), codec, len(y), feature, raw if keep_pcm else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, n_samples long, feature string, pcm binary"
    return media.select("doc_id", "n_bytes", "media").transform(common.arrow_map, run, schema)
