"""Hashes of words and of byte windows, computed over whole arrays."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20_240_229))
#: One 64-bit number per byte value, an odd multiplier and its inverse.
_OF_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_POWERS = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64."""
    known = _POWERS[base]
    while len(known) < n:
        factor = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * factor])
    _POWERS[base] = known if len(known) <= 1 << 23 else _POWERS[base]
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over the bytes before each place, each byte weighted by a power of the base."""
    return _weighted_sums(_OF_BYTE[data])


def code_point_sums(codes: np.ndarray) -> np.ndarray:
    """As prefix_sums, over code points."""
    return _weighted_sums(mixed(codes.astype(np.uint64) + np.uint64(_BASE)))


def _weighted_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span of bytes; equal bytes give equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than \\x20 and \\x09-\\x0D."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n successive hashes."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), dtype=np.uint64)
    for k in range(n):
        if count > 0:
            out = mixed(out * np.uint64(_BASE) + hashes[k : k + count])
    return out
