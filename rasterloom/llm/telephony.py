"""Media columns of telephony audio.

`encode` stores payloads losslessly as one-channel WAV files of 8,000 samples a second,
in mu-law or A-law (a byte a sample) or IMA ADPCM (a block of 576 bytes, 1,145 samples).
`decode` reads the stored bytes back: companded samples are expanded by lookup tables,
ADPCM blocks are decoded by numpy step by step across many blocks of a batch at once, and
the PCM is resampled to 16,000 samples a second and stored in a column of its own, as
16-bit little-endian samples. Beyond its samples and PCM, a text of any length takes the
memory of a run of blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK, RATE, PAD = 576, 8000, b"\xff"
#: ADPCM blocks that are decoded at once, and samples that are resampled or measured at once.
_BLOCKS, _SAMPLES = 2048, 1 << 20
#: WAVE format tags.
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
BLOCK_SAMPLES = 2 * (BLOCK - 4) + 1


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: sign, exponent and mantissa of the inverted byte."""
    b = ~np.arange(256) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, a linear first segment."""
    b = np.arange(256) ^ 0x55
    exponent, step = b >> 4 & 7, (b & 15) << 4
    size = np.where(exponent == 0, step + 8, step + 264 << np.maximum(exponent - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM (fixed values)."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


_MULAW, _ALAW, _STEPS = mulaw_table(), alaw_table(), adpcm_steps()
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, a row each: one step of all blocks at a time. An index beyond the table counts as its end."""
    blocks = np.ascontiguousarray(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1).T.astype(np.int32)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, code in enumerate(np.ascontiguousarray(codes)):
        step = _STEPS[index]
        move = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + _MOVES[code], 0, 88)
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: each in-between one is a half-band filter of its six neighbours (the ends repeat), rounded and clipped."""
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    for at in range(0, len(pcm), _SAMPLES):
        n = min(_SAMPLES, len(pcm) - at)
        x = pcm[np.clip(np.arange(at - 2, at + n + 3), 0, len(pcm) - 1)].astype(np.int32)
        mid = (3 * (x[:n] + x[5 : n + 5]) - 25 * (x[1 : n + 1] + x[4 : n + 4]) + 150 * (x[2 : n + 2] + x[3 : n + 3]) + 128) >> 8
        out[2 * at + 1 : 2 * (at + n) : 2] = np.clip(mid, -32768, 32767)
    return out


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file of the payload as it is; even sizes need no padding byte."""
    tag = FORMATS[codec]
    if codec == "adpcm":
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        samples = len(payload) // BLOCK * BLOCK_SAMPLES
    else:
        fmt, samples = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, memoryview]:
    """The codec and the data chunk of a stored file. Other formats raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    codec, at, view = None, 12, memoryview(media)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((c for c, t in FORMATS.items() if t == tag), None)
        elif name == b"data":
            if codec is None:
                raise ValueError("neither mu-law, A-law nor IMA ADPCM")
            return codec, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and with 255 up to a positive multiple of the block."""
    raw = (text or "").encode()
    return len(raw), raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, codec, media) of every row: media is the stored file. The codec goes by the payload's crc32, so equal texts give equal files. A null text is empty."""
    names = list(FORMATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sizes, codecs, media = [], [], []
                for n, payload in map(payload_of, part.column("text").to_pylist()):
                    sizes.append(n)
                    codecs.append(names[zlib.crc32(payload) % 3])
                    media.append(wav(payload, codecs[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(codecs), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, codec string, media binary")


def expand(files: list[bytes]) -> list[np.ndarray]:
    """16-bit samples at the stored rate of each file. The ADPCM blocks of all files are decoded in runs, across files."""
    read = [read_wav(m) for m in files]
    blocks = [np.frombuffer(d, np.uint8)[: len(d) // BLOCK * BLOCK].reshape(-1, BLOCK) for c, d in read if c == "adpcm"]
    ends = np.cumsum([len(b) for b in blocks], dtype=np.int64)
    every = blocks[0] if len(blocks) == 1 else np.concatenate(blocks) if blocks else np.zeros((0, BLOCK), np.uint8)
    samples = np.empty((len(every), BLOCK_SAMPLES), np.int16)
    for at in range(0, len(every), _BLOCKS):
        samples[at : at + _BLOCKS] = decode_adpcm(every[at : at + _BLOCKS])
    adpcm = iter(np.split(samples, ends[:-1]) if blocks else ())
    return [next(adpcm).reshape(-1) if codec == "adpcm" else (_MULAW if codec == "mulaw" else _ALAW)[np.frombuffer(data, np.uint8)] for codec, data in read]


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def _feature(codec: str, pcm: np.ndarray) -> str:
    total = squares = turns = 0
    for at in range(0, len(pcm), _SAMPLES):
        x = pcm[at : at + _SAMPLES + 1].astype(np.int64)
        turns += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:_SAMPLES]
        total, squares = total + int(x.sum()), squares + int((x * x).sum())
    return f"{codec}:{len(pcm)}:{int(pcm.min())}:{int(pcm.max())}:{total}:{squares}:{turns}"


def decode(stored: DataFrame) -> DataFrame:
    """Every stored row (doc_id, n_bytes, media) read back: FEATURES, and pcm (binary), the resampled samples.

    The feature holds codec, samples, least, greatest, sum, sum of squares and sign
    changes of the samples at the stored rate. Further columns are not read; repeated
    rows give repeated results.
    """
    schema = FEATURES + ", pcm binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                files = part.column("media").to_pylist()
                rows = []
                for media, samples in zip(files, expand(files)):
                    codec, data = read_wav(media)
                    pcm = resample(samples).tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), _feature(codec, samples), len(pcm), hashlib.sha256(pcm).hexdigest(), pcm))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
