"""Whole texts as byte arrays: vectorised words, shingles and hashes for Arrow batches.

A null text counts as empty.  Words are runs of bytes other than 0x20 and 0x09-0x0D.  Batches are
cut into slices of some megabytes of text, at least one row each, so that the arrays made from a
slice stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; kept for slices of the usual size."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = n if n > 2 * SLICE_BYTES else 1 << n.bit_length()
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = known
    return known[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end of the last."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums h with which (h[j] - h[i]) * inverse**i identifies data[i:j]; see span_hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, with its length."""
    raw = (sums[stops] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw + (stops - starts).astype(np.uint64) * _PLACES[-1])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words of all texts, and each text's first word, with their count at the end."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, lower case, and each text's first one, with their count at the end.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    data = LOWER[data]
    starts, stops, first = words(data, offsets)
    hashed = span_hashes(prefix_hashes(data), starts, stops)
    n = np.diff(first)
    sums = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        sums += hashed[k : k + len(sums)] * _PLACES[k]
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    place = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    out = np.zeros(begin[-1], np.uint64)
    whole = np.repeat(n >= size, counts)
    out[whole] = sums[place[whole]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        whole_text = hashed[first[d] : first[d + 1]] * _PLACES[: n[d]]
        out[begin[d]] = np.append(whole_text, _PLACES[32 + n[d]]).sum()
    return mix(out), begin
