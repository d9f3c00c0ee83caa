"""Vectorised kernels over the bytes of many texts at once: words, their hashes, n-grams, mixing."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240611)
#: A random odd multiplier, its inverse modulo 2**64, and a random 64-bit value for each byte.
BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 5
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, runs of bytes that the table `breaks` does not name, and the row of each."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    solid = ~breaks[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans, equal hashes, wherever they stand."""
    values = BYTES[LOWER] if lower else BYTES
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U(0x9E3779B97F4A7C15) + (right ^ U(0xD6E8FEB86659FD93)))


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the row of each."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = join_hashes(out, hashes[k : len(hashes) - n + 1 + k])
    inside = rows[: len(rows) - n + 1] == rows[n - 1 :]
    return out[inside], rows[: len(rows) - n + 1][inside]
