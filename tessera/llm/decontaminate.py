"""Benchmark decontamination (operator 7).

Seeds are pairs of words of a test item that are neighbours or have one word
between them, and they are looked up in the same pairs of a document.  Between two
matches of an alignment that follow each other with one edit or none, the words
are such a pair on both sides, and an alignment that is a leak has at least
``LEAST`` times the item's words, less one, of them: with m matches and x edits,
2 m - x >= 2 LEAST n, and at most x / 2 of the m - 1 steps have two edits or more.
Where so many places of an item have seeds in a stretch of the document that an
alignment can cover, the stretch is aligned with the item by Smith-Waterman over
words.  So all that the alignment accepts is reached, whatever the corpus.  The most
common pairs of an item are left out, and the number that is asked for is lowered by
as many; how common a pair is follows from how often its words occur.

The items are a query set.  They are taken to the tasks in blocks of a bounded
number of words, ``SCAN_BLOCKS`` blocks in one pass over the documents and one pass
that counts their words; nothing is shuffled but word counts.  Spark sends what is
over 1 MB of a function to each executor once, as a broadcast variable.  An item is
never cut, so an item of more words than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytehash import hashes, mix
from tessera.llm.rows import unwrapped, wrapped
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import raw, slices

LEAST_WORDS = 3  # of an item
STEPS = (1, 2)  # from the first to the second word of a seed
LEAST = 0.4  # share of the score of an exact copy from which an alignment is a leak
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_WORDS = 500_000
SCAN_BLOCKS = 4
_FILTER_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, lower-cased A-Z, and where each text's begin (one more at the end)."""
    data = np.full(sum(len(t) + 1 for t in texts), 0x20, np.uint8)
    at, ends = 0, np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        data[at : at + len(t)] = t
        at += len(t) + 1
        ends[i] = at
    edge = np.diff(_WORD[data].astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hashes(_LOWER[data], start, stop), np.r_[0, np.searchsorted(start, ends)]


def pairs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words, and the place of the first word of each."""
    found = [mix(mix(h[: max(0, len(h) - d)]) + h[d:]) for d in STEPS]
    return np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray


@dataclass
class Block:
    """Items and their seeds: sorted hashes, and the item and place that each is of; for each item the places that must have seeds, and the words that an alignment covers at most."""

    items: list[Item]
    need: np.ndarray
    span: np.ndarray
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    def table(self) -> np.ndarray:
        some = np.zeros(1 << _FILTER_BITS, bool)
        some[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return some


def seeded(items: list[Item], counts: dict[int, int], total: int) -> Block:
    """Seeds: the pairs at all places of an item but the most common, which are less than half of what an alignment must have."""
    seeds, owner, place = [], [], []
    need, span = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i, item in enumerate(items):
        n = len(item.words)
        p = np.array([max(1, counts.get(int(w), 0)) / max(1, total) for w in item.words])
        follow = p[1:].copy()
        follow[:-1] += p[2:]
        least = max(1, int(np.ceil(LEAST * n - 1 - 1e-9)))
        lost = (least - 1) // 2
        need[i], span[i] = least - lost, int(np.ceil((3 - 2 * LEAST) * n))
        kept = np.zeros(n, bool)
        kept[np.argsort(p[:-1] * follow, kind="stable")[: n - 1 - lost]] = True
        hashes, at = pairs(item.words)
        seeds.append(hashes[kept[at]])
        owner.append(np.full(len(seeds[-1]), i))
        place.append(at[kept[at]])
    every = np.concatenate([np.zeros(0, np.uint64), *seeds])
    order = np.argsort(every, kind="stable")
    return Block(items, need, span, every[order], np.concatenate([np.zeros(0, np.int64), *owner])[order], np.concatenate([np.zeros(0, np.int64), *place])[order])


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment as a share of an exact copy's score, and the place in ``text`` after its end."""
    m = len(text)
    slope = GAP * np.arange(m + 1)
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    for w in item:
        step = np.where(text == w, MATCH, -MISMATCH)
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + slope) - slope  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best / (MATCH * len(item)), end


def matches(h: np.ndarray, block: Block, table: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, word after the last) of each item that leaked into the words ``h``."""
    g, at = pairs(h)
    some = np.flatnonzero(table[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    g, at = g[some], at[some]
    low, high = np.searchsorted(block.seeds, g, "left"), np.searchsorted(block.seeds, g, "right")
    n = high - low
    if not n.sum():
        return
    which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner, place, at = block.owner[which], block.place[which], np.repeat(at, n)
    key = owner * (len(h) + int(block.span.max()) + 1) + at
    order = np.argsort(key, kind="stable")
    owner, place, at, key = owner[order], place[order], at[order], key[order]
    stop = np.searchsorted(key, key + block.span[owner], "left")
    stretches: list[list[int]] = []  # item, first word, word after the last
    for k in np.flatnonzero(stop - np.arange(len(key)) >= block.need[owner]).tolist():
        o, e = int(owner[k]), int(stop[k])
        if len(set(place[k:e].tolist())) < block.need[o]:
            continue
        size = int(block.span[o])
        a, b = max(0, int(at[k]) + 1 - size), min(len(h), int(at[k]) + size + max(STEPS))
        if stretches and stretches[-1][0] == o and a <= stretches[-1][2]:
            stretches[-1][2] = max(b, stretches[-1][2])
        else:
            stretches.append([o, a, b])
    best: dict[int, tuple[float, int, int]] = {}
    for o, a, b in stretches:
        item = block.items[o].words
        score, end = align(item, h[a:b])
        if score >= LEAST and score > best.get(o, (0.0, 0, 0))[0]:
            back, length = align(item[::-1], h[a : a + end][::-1])
            best[o] = (score, a + end - length, a + end)
    for o, (score, a, b) in best.items():
        yield o, score, a, b


def _counter(vocabulary: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(vocabulary >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        for batch in batches:
            for texts in slices(raw(batch.column("text"))):
                h, _ = words(texts)
                total += len(h)
                h = h[table[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
                at = np.searchsorted(vocabulary, h)
                at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == h]
                counts += np.bincount(at, minlength=len(vocabulary))[: len(vocabulary)]
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.r_[vocabulary[some].view(np.int64), 0]), pa.array(np.r_[counts[some], 0]), pa.array(np.r_[np.zeros(len(some), np.int64), total])], names=["word", "n", "total"])

    return rows


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The test items, a bounded number of words at a time."""
    held: list[Item] = []
    size = 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        h, _ = words([np.frombuffer(row.text.encode(), np.uint8)])
        if len(h) < LEAST_WORDS:
            continue
        held.append(Item(row.item_id, h))
        size += len(h)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def fitted_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Block]]:
    """The blocks of each pass, with seeds chosen by how often their words occur in all of ``docs``."""
    text, blocks = docs.select(F.coalesce("text", F.lit("")).alias("text")), _blocks(benchmark)
    while group := list(islice(blocks, SCAN_BLOCKS)):
        vocabulary = np.unique(np.concatenate([i.words for items in group for i in items]))
        # as many rows as the blocks have distinct words, and the total
        counted = text.mapInArrow(_counter(vocabulary), "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        counts, total = {int(np.int64(r.word).view(np.uint64)): r.n for r in counted}, sum(r.total for r in counted)
        yield [seeded(items, counts, total) for items in group]


def _found(h: np.ndarray, blocks: list[tuple[Block, np.ndarray]]) -> Iterator[tuple]:
    """(item_id, score, first word, word after the last) of each item that leaked into the words ``h``."""
    for block, table in blocks:
        for o, score, a, b in matches(h, block, table):
            yield block.items[o].item_id, score, a, b


def _matcher(blocks: list[Block]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(b, b.table()) for b in blocks]
        for batch in batches:
            ids, out = iter(batch.column("doc_id").to_pylist()), []
            for texts in slices(raw(batch.column("text"))):
                h, first = words(texts)
                for i in range(len(texts)):
                    doc_id = next(ids)
                    out.extend((doc_id, *x) for x in _found(h[first[i] : first[i + 1]], tables))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): test items in documents, the best place of each.

    Scores are shares of an exact copy's, from ``LEAST`` to 1.  Null and empty texts
    hold nothing; items of fewer than three words are never found; repeated
    documents and repeated items are reported each.  An empty table on either side
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch, out = Scratch(docs.sparkSession, "leaks"), None
    for k, blocks in enumerate(fitted_blocks(docs, benchmark)):
        found = scratch.table(rows.mapInArrow(_matcher(blocks), "doc_id long, item_id long, score double, first_word long, end_word long"), f"pass-{k}")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")


def _cleaner(blocks: list[Block]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(b, b.table()) for b in blocks]
        for batch in batches:
            clean = []
            for texts in slices(raw(batch.column("text"))):
                h, first = words(texts)
                clean.extend(next(_found(h[first[i] : first[i + 1]], tables), None) is None for i in range(len(texts)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return rows


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without test items, with the columns of ``docs``."""
    out = wrapped(docs, text=F.coalesce("text", F.lit("")))
    for blocks in fitted_blocks(docs, benchmark):
        out = out.mapInArrow(_cleaner(blocks), out.schema)
    return unwrapped(out)
