"""Hashes of stretches of bytes, for NumPy.

``Stretches`` has the polynomial of any stretch mod 2^64 from prefix sums.  Equal
stretches have equal polynomials, but there are known strings that clash under each
base, so it may choose among places and never says that two stretches are equal.
``hashes`` and ``xxh3`` say that: they mix each eight bytes into a state.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) at least, kept and grown by doubling."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            table[done : 2 * done] = table[:done] * step
            done *= 2
        _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Stretches:
    """Identifiers of the stretches of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(INVERSE, n + 1)

    def ids(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.prefix[stop] - self.prefix[start]) * self.inverse[start]
        return mix(h + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


LONG = 64  # bytes from which a stretch is hashed on its own
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``start`` to ``stop`` of ``data`` (uint8), eight bytes of each at a time."""
    eights = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    left = stop - start
    out = mix(left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0x9FB21C651E98DF25))
    for k in np.flatnonzero(left > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]].tobytes(), int(left[k]) & 0xFFFFFFFF)
    some = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = start[some], left[some]
    while len(some):
        chunk = np.ascontiguousarray(eights[at]).view("<u8").ravel() & _MASK[np.minimum(left, 8)]
        out[some] = mix((out[some] ^ chunk) + np.uint64(0x8EBC6AF09C88C6E3))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out
