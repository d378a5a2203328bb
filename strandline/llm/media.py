"""Telephony audio in media columns.

Stored form: a RIFF/WAVE file of one channel at 8 kHz whose data chunk is the payload as it is: G.711 mu-law or A-law (one
byte a sample) or IMA ADPCM in blocks of 64 bytes (four of state, then 120 four-bit steps). Every byte string whose length
is a positive multiple of 64 is a valid payload of each format, so storing loses nothing.

Reading expands mu-law and A-law by tables of 256 entries, decodes ADPCM blocks with numpy across all blocks of a batch
(step by step in time, all blocks at once), and resamples to 16-bit PCM at another rate with a polyphase filter in
integers, so that results are the same everywhere. The PCM is stored as a WAVE file of its own.

Null and empty texts are a payload of 64 zero bytes. Texts of any length are stored whole; equal texts give equal values, also in
repeated rows; an empty table gives no rows. Of the input only the id and the text are read, so that further columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import arrow_type, chunks, fields, text_column

RATE = 8000
PCM_RATE = 16000
BLOCK = 64
CODECS = ("mulaw", "alaw", "adpcm")
# The WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11, "pcm": 1}
# The IMA table that moves the step index, for the three low bits of a code.
INDEX_MOVE = (-1, -1, -1, -1, 2, 4, 6, 8)


@functools.cache
def mulaw_table() -> np.ndarray:
    """Sample of each code: inverted bits are sign, three of exponent, four of mantissa over a bias of 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """Sample of each code, of which every second bit is inverted; segment 0 is linear, the others have a leading one."""
    code = np.arange(256) ^ 0x55
    segment, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment, mantissa + 264 << np.maximum(segment - 1, 0), mantissa + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


@functools.cache
def step_table() -> np.ndarray:
    """The 89 ADPCM steps."""
    # The published table.
    steps = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(steps, np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Rows of BLOCK bytes to rows of 1 + 2 * (BLOCK - 4) samples."""
    n = len(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    # time is the first axis here, so that each step works on adjacent memory
    codes = np.empty((2 * (BLOCK - 4), n), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((1 + len(codes), n), np.int16)
    out[0] = value
    steps, move = step_table(), np.array(INDEX_MOVE * 2, np.int32)
    for t, code in enumerate(codes):
        step = steps[index]
        size = step >> 3
        size += (step >> 2) * (code & 1)
        size += (step >> 1) * (code >> 1 & 1)
        size += step * (code >> 2 & 1)
        value += np.where(code & 8, -size, size)
        np.clip(value, -32768, 32767, out=value)
        index += move[code]
        np.clip(index, 0, 88, out=index)
        out[t + 1] = value
    return out.T


@functools.cache
def _filter(up: int, down: int, half: int = 4) -> np.ndarray:
    """Rows of 2 * half weights for each phase of `up`, in 1/32768; the weights of a phase sum to 1."""
    cut = min(1.0, up / down)
    phase = np.arange(up)[:, None] / up
    t = np.arange(1 - half, half + 1)[None, :] - phase
    h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
    h = np.round(h / h.sum(axis=1, keepdims=True) * 32768).astype(np.int32)
    h[:, half - 1] += 32768 - h.sum(axis=1)
    return h


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate; edges repeat."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(pcm) * up // down)
    h = _filter(up, down)
    half = h.shape[1] // 2
    x = np.concatenate([np.full(half - 1, pcm[0]), pcm, np.full(half + 1, pcm[-1])]).astype(np.int32)
    out = np.empty(n, np.int16)
    for start in range(min(up, n)):
        # outputs start, start + up, ... share a phase, and their inputs lie `down` apart
        first, phase = divmod(start * down, up)
        m = len(range(start, n, up))
        acc = np.full(m, 1 << 14, np.int32)
        for k in np.flatnonzero(h[phase]).tolist():
            acc += x[first + k : first + k + (m - 1) * down + 1 : down] * h[phase, k]
        out[start::up] = np.clip(acc >> 15, -32768, 32767)
    return out


def wave(codec: str, data: bytes, rate: int) -> bytes:
    """A WAVE file of one channel."""
    extra = b""
    bits, align, per_second = 8, 1, rate
    if codec == "pcm":
        bits, align, per_second = 16, 2, 2 * rate
    elif codec == "adpcm":
        samples = 1 + 2 * (BLOCK - 4)
        bits, align, per_second, extra = 4, BLOCK, rate * BLOCK // samples, struct.pack("<HH", 2, samples)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, align, bits) + extra
    head = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF)
    return b"RIFF" + struct.pack("<I", (len(head) + len(data)) & 0xFFFFFFFF) + head + data


def read_wave(media: bytes) -> tuple[str, int, memoryview]:
    """Codec, rate and data of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            return codec, rate, memoryview(media)[at + 8 :]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zeros up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def codec_of(payload: bytes) -> str:
    """Spreads payloads over the formats by their content alone."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def expand(stored: list[tuple[str, memoryview]]) -> list[np.ndarray]:
    """16-bit samples of stored data of any codec; the ADPCM blocks of all are decoded together."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, BLOCK) for c, d in stored if c == "adpcm"]
    samples = decode_adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for c, d in stored:
        if c == "adpcm":
            n = len(d) // BLOCK
            out.append(np.ascontiguousarray(samples[at : at + n]).reshape(-1))
            at += n
        elif c == "pcm":
            out.append(np.frombuffer(d, "<i2"))
        else:
            out.append(tables[c][np.frombuffer(d, np.uint8)])
    return out


def feature(codec: str, pcm: np.ndarray, rate: int) -> str:
    x = pcm.astype(np.int64)
    energy = int((x * x).sum() // len(x))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};ms={len(x) * 1000 // rate};peak={int(np.abs(x).max())};rms={math.isqrt(energy)};zero_crossings={crossings}"


FIELDS = "n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,pcm_bytes:bigint,pcm_sha256:string,feature:string"
FILES = ",media:binary,pcm:binary"
#: Characters whose stored files leave a task at once, unless a single text is longer.
FILE_CHARS = 500_000


def _store(texts: list[str | None], keep: bool, pcm_rate: int) -> list[list]:
    """The columns of FIELDS and, if kept, of FILES."""
    sizes, files = [], []
    for t in texts:
        n, payload = payload_of(t)
        sizes.append(n)
        files.append(wave(codec_of(payload), payload, RATE))
    read = [read_wave(f) for f in files]
    pcm = [resample(x, rate, pcm_rate) for x, (_, rate, _) in zip(expand([(c, d) for c, _, d in read]), read, strict=True)]
    stored = [wave("pcm", x.astype("<i2", copy=False).tobytes(), pcm_rate) for x in pcm]
    cols = [
        sizes,
        [len(d) for _, _, d in read],
        [hashlib.sha256(d).hexdigest() for _, _, d in read],
        [zlib.crc32(d[-BLOCK:]) for _, _, d in read],
        [len(f) for f in files],
        [hashlib.sha256(f).hexdigest() for f in files],
        [len(f) for f in stored],
        [hashlib.sha256(f).hexdigest() for f in stored],
        [feature(c, x, pcm_rate) for (c, _, _), x in zip(read, pcm, strict=True)],
    ]
    return [*cols, files, stored] if keep else cols


def media_column(text: Column, keep: bool = True, pcm_rate: int = PCM_RATE) -> Column:
    """Struct column: n_bytes, payload_bytes, payload_sha256, tail_crc32 (all of the bytes read back), media_bytes,
    media_sha256, pcm_bytes, pcm_sha256, feature and, if kept, media and pcm, the two stored files."""
    return text_column(text, FIELDS + FILES * keep, lambda: lambda texts: _store(texts, keep, pcm_rate))


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, pcm_rate: int = PCM_RATE) -> DataFrame:
    """One row per row of docs: the id and the columns of media_column; other columns are left out. Rows with files leave a task in
    batches of their own, as files are several times the texts."""
    if not keep:
        return docs.select(F.col(id_col), media_column(F.col(text_col), False, pcm_rate).alias("m")).select(id_col, "m.*")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = fields(FIELDS + FILES)

    def run(batches):
        for b in batches:
            at, texts = 0, b["text"]
            for some in chunks(texts.to_pylist(), FILE_CHARS):
                cols = [pa.array(c, arrow_type(t)) for c, (_, t) in zip(_store(some, True, pcm_rate), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(some)), *cols], ["id", *(n for n, _ in kinds)])
                at += len(some)

    out = given.mapInArrow(run, f"id {dict(given.dtypes)['id']}, " + ", ".join(f"{n} {t}" for n, t in kinds))
    return out.withColumnRenamed("id", id_col)
