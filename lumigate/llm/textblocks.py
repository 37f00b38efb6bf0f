"""Numpy helpers over Arrow batches of texts.

Everything here works on the UTF-8 bytes of a whole Arrow text column at once,
so that no Python string is made for a word, a line or a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked through in runs of about this many bytes; a longer text is a run of its own.
CHUNK_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null reads as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (first row, row past the last, bytes, offsets from 0)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes; no run crosses a text's border."""
    n = len(keep)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = keep[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = keep[1:]
    starts = np.flatnonzero(keep & (~before | border[:-1]))
    ends = np.flatnonzero(keep & (~after | border[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a polynomial."""
    n = len(data)
    terms = BYTE_CODES[data] * _power("up", _BASE, n + 1)[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INV, n + 1)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = LOWER_AZ) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of texts and, per text, where its words begin (one more at the end)."""
    if fold is not None:
        data = fold[data]
    starts, ends = spans(~IS_SPACE[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, in order, and where each text's begin.

    A text of fewer words than the width has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(made)))
    odd = [np.uint64((2 * k + 1) * 0xA0761D6478BD642F % 2**64 | 1) for k in range(width)]
    total = max(len(words) - width + 1, 0)
    rolling = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        rolling += mix64(words[k : k + total] * odd[k])
    out = np.empty(begin[-1], dtype=np.uint64)
    full = counts >= width
    if full.any():
        row = np.repeat(np.flatnonzero(full), made[full])
        at = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(made[full]) - made[full], made[full]))
        out[np.repeat(full, made)] = mix64(rolling[at])
    for i in np.flatnonzero((counts > 0) & ~full):
        h = counts[i : i + 1].astype(np.uint64)
        for w in words[first[i] : first[i + 1]]:
            h = mix64(h * np.uint64(_BASE) + w)
        out[begin[i]] = h[0]
    return out, begin


def distinct_sorted(values: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct values of each text in turn."""
    for i in range(len(begin) - 1):
        own = np.sort(values[begin[i] : begin[i + 1]])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
