"""Words of many texts at once as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd factors of the polynomial hashes (odd: they have inverses modulo 2**64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all their bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(n, 1 << 16).bit_length()
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def range_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run values[first:end]: equal runs have equal hashes wherever they stand."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(BYTE_BASE))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words (runs of anything but ASCII white space) of texts that lie one after
    the other in data, text i from at[i] to at[i + 1]; and where each text's words begin."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins (or the last ends) here
    edge[at] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return range_hashes(data.astype(np.uint64) + np.uint64(1), first, end, BYTE_BASE), np.searchsorted(first, at)
