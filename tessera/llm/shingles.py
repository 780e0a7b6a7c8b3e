"""Hashed words and word shingles of texts, for NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.bytehash import hashes, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
SLICE_BYTES = 1 << 18
_LOWER[ord("A") : ord("Z") + 1] += 32


def _turn(j: int) -> np.uint64:
    """What tells the j-th word of a shingle from the others."""
    return np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def raw(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; null is empty."""
    for x in column:
        b = x.as_buffer() if x.is_valid else b""
        yield np.frombuffer(b, np.uint8) if len(b) else np.zeros(0, np.uint8)


def slices(texts: Iterator[np.ndarray], most: int = SLICE_BYTES) -> Iterator[list[np.ndarray]]:
    """Lists of whole texts of about ``most`` bytes together."""
    held: list[np.ndarray] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts``, lower-cased A-Z, and the places where each text's words begin (one more at the end)."""
    size = sum(len(t) + 1 for t in texts)
    data = np.full(size, 0x20, np.uint8)
    at, ends = 0, np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        data[at : at + len(t)] = t
        at += len(t) + 1
        ends[i] = at
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = hashes(_LOWER[data], start, stop)
    return h, np.r_[0, np.searchsorted(start, ends)]


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles and where each text's begin; a text with fewer words is one shingle, one without words none."""
    n = np.diff(first)
    total = len(h)
    acc = np.zeros(total, np.uint64)
    for j in range(min(width, total)):
        acc[: total - j] += mix(h[j:] + _turn(j))
    acc = mix(acc + np.uint64(width))
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begins = np.r_[0, np.cumsum(count)]
    source = np.repeat(first[:-1], count) + np.arange(begins[-1]) - np.repeat(begins[:-1], count)
    out = acc[source]
    for i in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence
        part = h[first[i] : first[i + 1]]
        out[begins[i]] = mix(np.array([sum(int(mix(part[j : j + 1] + _turn(j))[0]) for j in range(len(part))) % (1 << 64)], np.uint64) + np.uint64(len(part)))[0]
    return out, begins


def sets(texts: list[np.ndarray], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, begins = windows(*words(texts), width)
    for i in range(len(texts)):
        yield np.unique(out[begins[i] : begins[i + 1]])
