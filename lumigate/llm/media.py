"""Media columns: telephony audio (mu-law, A-law, ADPCM) held in binary columns.

Mu-law and A-law samples expand by lookup tables made from their rules. IMA ADPCM blocks decode
with numpy across blocks: one step works on the same nibble of every block of a run. Expanded
samples are resampled and stored as 16-bit PCM in WAV.

A text can be stored as such a sound without loss: its UTF-8 bytes, padded with spaces to a multiple
of BLOCK_BYTES, are the 8-bit samples of a mu-law WAV.

Defined cases: a null or empty text pads to one block of spaces; a null doc_id stays null; a null sound reads as none
and gives nulls; a sound that is not WAV of a known format is an error that names the format; a text of any length is one
sound; equal texts give equal rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

BLOCK_BYTES = 192
RATE, TARGET_RATE = 8000, 16000
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
RUN_BYTES = 2 << 20

# Fixed values of IMA ADPCM.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279,
    307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    size = np.where(part == 0, step, step + 0x100 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, b) bytes of mono IMA ADPCM blocks -> (n, 1 + 2 (b - 4)) int16 samples.

    A block begins with its first sample, the step index (taken modulo its range) and a spare byte.
    """
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = blocks[:, 2].astype(np.int32) % len(STEPS)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for byte in body:
        for nibble in (byte & 15, byte >> 4):
            step = STEPS[index]
            delta = step >> 3
            delta += np.where(nibble & 4, step, 0)
            delta += np.where(nibble & 2, step >> 1, 0)
            delta += np.where(nibble & 1, step >> 2, 0)
            value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + INDEX_STEPS[nibble], 0, len(STEPS) - 1)
            out[at] = value
            at += 1
    return out.T


def double_rate(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the floored mean of it and the next (the last repeats)."""
    out = np.empty(2 * len(samples), dtype=np.int16)
    out[::2] = samples
    if len(samples):
        following = np.append(samples[1:], samples[-1]).astype(np.int32)
        out[1::2] = (samples.astype(np.int32) + following) >> 1
    return out


def wav(kind: int, data: bytes, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAV file; ADPCM in blocks of BLOCK_BYTES."""
    frame = BLOCK_BYTES if kind == IMA_ADPCM else bits // 8
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * frame, frame, bits, 0)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(data) // frame) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, data) of a mono WAV file."""
    kind, rate, _, data = _read_wav(media)
    return kind, rate, data


def _read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, bytes a block, data)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, block = 12, -1, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if channels != 1:
                raise ValueError("not mono")
            block = struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            return kind, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAV file")


def expand(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV in mu-law, A-law, ADPCM of whole blocks of the length its header states, or PCM."""
    kind, rate, block, data = _read_wav(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if kind in (MULAW, ALAW):
        return rate, (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[raw]
    if kind == IMA_ADPCM:
        if block <= 4 or len(raw) % block:
            raise ValueError(f"ADPCM of {len(raw)} bytes in blocks of {block}")
        return rate, decode_adpcm(raw.reshape(-1, block)).ravel()
    if kind == PCM:
        return rate, np.frombuffer(data, dtype="<i2").astype(np.int16)
    raise ValueError(f"unknown WAV format {kind}")


def to_pcm(rows: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, pcm: each sound expanded, resampled from 8 to 16 kHz, as 16-bit PCM WAV."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                out = []
                for media in part.column(1).to_pylist():
                    if media is not None:
                        rate, samples = expand(media)
                        if rate * 2 == TARGET_RATE:
                            rate, samples = TARGET_RATE, double_rate(samples)
                        media = wav(PCM, samples.astype("<i2").tobytes(), rate, 16)
                    out.append(media)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "pcm"])

    return rows.select("doc_id", column).mapInArrow(shared.trimmed(work), "doc_id long, pcm binary")


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the bytes padded with spaces to a positive multiple of BLOCK_BYTES."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % BLOCK_BYTES if raw else BLOCK_BYTES)


def text_to_sound(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as the samples of a mu-law WAV."""
    shared.bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_bytes", "media"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, data = payload(text.as_py())
                rows.append((doc_id, n, wav(MULAW, data)))
                held += len(data)
                if held > RUN_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), shared.text_column(docs).alias("text"))
    return rows.mapInArrow(shared.trimmed(work), "doc_id long, n_bytes long, media binary")


def _features(sounds: list[bytes]) -> list[str]:
    """Of the samples of each sound: levels under both laws, its samples as ADPCM blocks, and its resampled PCM."""
    lengths = np.array([len(s) for s in sounds])
    raw = np.frombuffer(b"".join(sounds), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    mu, a = MULAW_TABLE[raw].astype(np.int64), ALAW_TABLE[raw].astype(np.int64)
    mu_power, a_power = np.add.reduceat(mu * mu, first), np.add.reduceat(a * a, first)
    peak = np.maximum.reduceat(np.abs(mu), first)
    turns = np.concatenate(([0], (mu[1:] >= 0) != (mu[:-1] >= 0))).astype(np.int64)
    turns[first] = 0
    crossings = np.add.reduceat(turns, first)
    adpcm = decode_adpcm(raw.reshape(-1, BLOCK_BYTES))
    block = first // BLOCK_BYTES
    levels = np.add.reduceat(np.abs(adpcm.astype(np.int64)).sum(axis=1), block)
    out = []
    for i, size in enumerate(lengths.tolist()):
        blocks = adpcm[block[i] : block[i] + size // BLOCK_BYTES]
        fast = double_rate(MULAW_TABLE[raw[first[i] : first[i] + size]])
        out.append(
            f"mulaw_ms={mu_power[i] // size};alaw_ms={a_power[i] // size};peak={peak[i]};crossings={crossings[i]};"
            f"adpcm_level={levels[i] // blocks.size};adpcm_crc32={zlib.crc32(np.ascontiguousarray(blocks, dtype='<i2'))};pcm16k_crc32={zlib.crc32(fast.astype('<i2', copy=False))}"
        )
    return out


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def sound_digests(sounds: DataFrame) -> DataFrame:
    """Per stored sound (doc_id, n_bytes, media): its payload's and its file's digests, and features of its samples.

    A null sound has nulls but for doc_id and n_bytes; one without samples has no feature.
    """
    shared.bound_batches(sounds.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split(" ")[0] for c in DIGESTS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            features = iter(_features([back for *_, back in rows if back]) if any(back for *_, back in rows) else ())
            out = [(*r, next(features) if back else None) for *r, back in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                if media is None:
                    rows.append((doc_id, n, None, None, None, None, None, None))
                    continue
                _, _, back = read_wav(media)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), back))
                held += len(back)
                if held > RUN_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return sounds.select("doc_id", "n_bytes", "media").mapInArrow(shared.trimmed(work), DIGESTS)


def stored_digests(docs: DataFrame) -> DataFrame:
    """The texts stored as a column of sounds in the shared folder, read back from there and digested; the stored column goes with the job."""
    with shared.Steps(docs.sparkSession) as steps:
        sounds = steps.write(text_to_sound(docs), "sounds")
        return steps.write(sound_digests(sounds), "digests", keep=True)
