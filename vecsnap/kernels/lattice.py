"""NumPy lattice kernels: nearest E8 point, nearest codeword, scalar levels."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np


def _even_sum_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even coordinate sum; ``x`` is laid out (8, n)."""
    point = np.rint(x)
    gap = x - point
    odd = np.flatnonzero(np.mod(point.sum(axis=0), 2.0))
    if odd.size:
        wrong = gap[:, odd]
        at = np.abs(wrong).argmax(axis=0)
        cols = np.arange(odd.size)
        point[at, odd] += np.where(wrong[at, cols] < 0.0, -1.0, 1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of every 8-block of ``x`` (last axis a multiple of 8).

    Coordinates run along the first axis while working, so that all reductions
    over the eight coordinates are vector operations over the blocks.
    """
    cols = np.ascontiguousarray(x.reshape(-1, 8).T)
    whole = _even_sum_point(cols)
    half = _even_sum_point(cols - 0.5) + 0.5
    d_whole = np.square(cols - whole).sum(axis=0)
    d_half = np.square(cols - half).sum(axis=0)
    return np.where(d_half < d_whole, half, whole).T.reshape(x.shape)


@functools.lru_cache(maxsize=1)
def e8_codebook() -> np.ndarray:
    """The 240 minimal E8 vectors scaled to unit length.

    Order (part of the code format): integer vectors by coordinate pair with signs
    ++, +-, -+, --; then half vectors by the binary number of their minus signs.
    """
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for si, sj in itertools.product((1.0, -1.0), repeat=2):
            row = [0.0] * 8
            row[i], row[j] = si, sj
            rows.append(row)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            rows.append([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
    return np.array(rows) / math.sqrt(2.0)


def best_codeword(blocks: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the largest inner product per block (first wins) and that product.

    Runs over short row ranges, so the score matrix stays in the processor cache.
    """
    best = np.empty(len(blocks), dtype=np.int64)
    score = np.empty(len(blocks))
    columns = codebook.T
    for start in range(0, len(blocks), 512):
        scores = blocks[start : start + 512] @ columns
        top = scores.argmax(axis=1)
        best[start : start + 512] = top
        score[start : start + 512] = scores[np.arange(len(top)), top]
    return best, score


def pad_to(x: np.ndarray, width: int) -> np.ndarray:
    """Right zero-pad the rows to a multiple of ``width``."""
    extra = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def code_keys(doubled: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Exact grouping key of 8-coordinate integer codes.

    Two longs hold the eight coordinates when all fit 16 bits; any other code is
    kept whole in the third (binary) part with the longs set to zero.
    """
    fits = (np.abs(doubled) <= 32767).all(axis=1)
    small = np.where(fits[:, None], doubled, 0).astype(np.int16)
    packed = np.ascontiguousarray(small).view(np.int64).reshape(-1, 2)
    wide: list[bytes | None] = [None] * len(doubled)
    for r in np.flatnonzero(~fits):
        wide[r] = doubled[r].astype(np.int64).tobytes()
    return packed[:, 0], packed[:, 1], wide
