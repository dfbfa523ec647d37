"""Word shingles of Arrow text columns as 64-bit hashes, whole batches at a time in NumPy.

Words are runs of bytes outside ``\\x20\\x09-\\x0D`` with A-Z lowered; a shingle is five words in a
row, or the whole sequence of a shorter text. Hashes are 64 bits wide: two different shingles of
two compared texts coincide with a chance of about 1e-13 for texts of a thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
# Bytes of text hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20)
# A random value per byte, equal for A-Z and a-z.
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word, and the offsets of each row's words."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True  # a row's first byte never continues the row before
    start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | fresh[:-1]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | fresh[1:])) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(_STEP, len(data)), out=total[1:])
    hashes = mix((total[end] - total[start]) * _powers(_BACK, len(data))[start])
    return hashes, start, end, np.searchsorted(start, offsets)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in text order, and the offsets of each row's."""
    n = np.diff(bounds)
    counts = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(np.int64))
    out_bounds = np.r_[0, np.cumsum(counts)]
    padded = np.r_[hashes, np.zeros(WIDTH, dtype=np.uint64)]
    full = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(WIDTH):
        full += padded[k : k + len(hashes)] * _PLACE[k]
    full = mix(full)
    row = np.repeat(np.arange(len(n)), counts)
    out = full[bounds[row] + np.arange(len(row)) - out_bounds[row]] if len(row) else full[:0]
    for r in np.flatnonzero((n > 0) & (n < WIDTH)):  # a short text is one shingle of its own kind
        h = hashes[bounds[r] : bounds[r + 1]]
        one = (h * _PLACE[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
        out[out_bounds[r]] = mix(np.array([one]))[0] ^ np.uint64(0x5851F42D4C957F2D)
    return out, out_bounds


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for first, data, offsets in slices(column):
        hashes, _, _, bounds = word_hashes(data, offsets)
        shingles, cuts = shingle_hashes(hashes, bounds)
        for r in range(len(cuts) - 1):
            yield first + r, np.unique(shingles[cuts[r] : cuts[r + 1]])
