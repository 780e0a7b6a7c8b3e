"""Expressions on bit-planes: 64 rows in a word, all blocks of a batch at once in NumPy.

A plane is an array (blocks, 64) whose column b has bit b of the rows; a mask is one
word for each block.  Sums are counts of bits, so no row is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.plans.ir import MASK, Node

ROWS = 64
WORD = 1 << 64
_ONES = np.uint64(WORD - 1)


class Kernel:
    """Evaluates nodes over ``planes``, the arrays of the fields."""

    def __init__(self, planes: dict[str, np.ndarray], blocks: int):
        self.planes, self.blocks = planes, blocks

    def mask(self, n: Node) -> np.ndarray:
        if n.kind == "and":
            return self.mask(n.args[0]) & self.mask(n.args[1])
        if n.kind == "or":
            return self.mask(n.args[0]) | self.mask(n.args[1])
        if n.kind == "not":
            return ~self.mask(n.args[0])
        a, b = self.plane(n.args[0]), self.plane(n.args[1])
        if n.kind in ("lt", "le"):
            a, b = b, a
        above, equal = np.zeros(self.blocks, np.uint64), np.full(self.blocks, _ONES)
        for k in range(ROWS - 1, -1, -1):  # from the top bit down
            above |= equal & a[:, k] & ~b[:, k]
            equal &= ~(a[:, k] ^ b[:, k])
        return equal if n.kind == "eq" else above if n.kind in ("gt", "lt") else above | equal

    def plane(self, n: Node) -> np.ndarray:
        return getattr(self, f"_{n.kind}")(n)

    def _load(self, n: Node) -> np.ndarray:
        return self.planes[n.name]

    def _const(self, n: Node) -> np.ndarray:
        word = n.value % WORD
        return np.broadcast_to(np.array([_ONES if word >> k & 1 else np.uint64(0) for k in range(ROWS)]), (self.blocks, ROWS))

    @staticmethod
    def _plus(a: np.ndarray, b: np.ndarray, carry: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        for k in range(a.shape[1]):
            either = a[:, k] ^ b[:, k]
            out[:, k] = either ^ carry
            carry = (a[:, k] & b[:, k]) | (carry & either)
        return out

    def _none(self) -> np.ndarray:
        return np.zeros(self.blocks, np.uint64)

    def _add(self, n: Node) -> np.ndarray:
        return self._plus(np.array(self.plane(n.args[0])), self.plane(n.args[1]), self._none())

    def _sub(self, n: Node) -> np.ndarray:
        return self._plus(np.array(self.plane(n.args[0])), ~self.plane(n.args[1]), ~self._none())

    @staticmethod
    def _shifted(a: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(a.shape, np.uint64)
        if -ROWS < n < ROWS:
            out[:, max(0, n) : ROWS + min(0, n)] = a[:, max(0, -n) : ROWS - max(0, n)]
        return out

    def _mul(self, n: Node) -> np.ndarray:
        a, b, out = self.plane(n.args[0]), self.plane(n.args[1]), np.zeros((self.blocks, ROWS), np.uint64)
        for k in range(ROWS):
            if b[:, k].any():
                out = self._plus(out, self._shifted(a, k) & b[:, k, None], self._none())
        return out

    def _lsl(self, n: Node) -> np.ndarray:
        return self._shifted(self.plane(n.args[0]), n.value)

    def _lsr(self, n: Node) -> np.ndarray:
        return self._shifted(self.plane(n.args[0]), -n.value)

    def _votes(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros((self.blocks, ROWS), np.uint64)
        out[:, 0] = mask
        return out

    def _inference_count(self, n: Node) -> np.ndarray:
        return self._votes(self.mask(n.args[0]))

    def _popcnt(self, n: Node) -> np.ndarray:
        if n.args[0].result == MASK:
            return self._inference_count(n)
        a, out = self.plane(n.args[0]), np.zeros((self.blocks, ROWS), np.uint64)
        for k in range(ROWS):  # a counter of seven planes, one bit added after the other
            carry = a[:, k].copy()
            for j in range(7):
                out[:, j], carry = out[:, j] ^ carry, out[:, j] & carry
        return out

    def _select(self, n: Node) -> np.ndarray:
        m = self.mask(n.args[0])[:, None]
        return (self.plane(n.args[1]) & m) | (self.plane(n.args[2]) & ~m)

    def matches(self, mask: np.ndarray, real: np.ndarray) -> int:
        return int(np.bitwise_count(mask & real).sum(dtype=np.int64))

    def total(self, n: Node, real: np.ndarray) -> int:
        """The sum over real rows mod 2^64; the matches of a mask."""
        if n.result == MASK:
            return self.matches(self.mask(n), real)
        if n.kind == "sum":
            return sum(self._tree(t, real) for t in n.args) % WORD
        if n.kind == "add" and any(x.kind == "sum" for x in n.args):
            forest, constant = n.args if n.args[0].kind == "sum" else n.args[::-1]
            return (self.total(forest, real) + self.matches(real, real) * constant.value) % WORD
        counts = np.bitwise_count(self.plane(n) & real[:, None]).sum(axis=0, dtype=np.int64)
        return sum(int(c) << k for k, c in enumerate(counts)) % WORD

    def _tree(self, t: Node, real: np.ndarray) -> int:
        if t.result == MASK:
            return t.weight * self.matches(self.mask(t), real)
        if t.kind == "select" and t.args[1].kind == t.args[2].kind == "const":
            high, low = t.args[1].value, t.args[2].value
            return low * self.matches(real, real) + (high - low) * self.matches(self.mask(t.args[0]), real)
        return self.total(t, real)


def real_rows(n_rows: np.ndarray) -> np.ndarray:
    """The words of the rows that blocks have; what a short block lacks is 0."""
    some = np.clip(n_rows, 0, ROWS - 1).astype(np.uint64)
    return np.where(n_rows >= ROWS, _ONES, (np.uint64(1) << some) - np.uint64(1))


def partial_sums(planes: DataFrame, n: Node, fields: list[str]) -> DataFrame:
    """(value), raw bits, a row for each batch of blocks: only the planes of ``fields`` are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {f: batch.column(f).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, ROWS) for f in fields}
            kernel = Kernel(words, batch.num_rows)
            value = kernel.total(n, real_rows(batch.column("n_rows").to_numpy(zero_copy_only=False)))
            yield pa.record_batch([pa.array(np.array([value % WORD], np.uint64).view(np.int64))], names=["value"])

    return planes.select("n_rows", *fields).mapInArrow(rows, "value long")
