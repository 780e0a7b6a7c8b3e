"""Removal of byte strings that occur more than once (operator 1).

Buckets over a sparse set of suffixes.  Of each window of ``DEPTH`` bytes the suffix
whose initial q-gram bucket is least is its anchor; equal windows have their anchors
at equal places, so only anchors are grouped (one in some fifty suffixes).  A bucket
of one anchor is done: none of its windows repeats.  The others are refined by
stretches around the anchor, at offsets further and further out:

* the stretch that all windows of a block have in common is alone in its bucket:
  no window of the block repeats;
* the stretch that covers the block shares its bucket: all of them repeat;
* else the block is cut into smaller blocks and refined again with the stretches
  at the next offsets, down to single windows.

What an earlier round has decided is not looked at again.  Buckets are counted with
partial aggregation and joined back from a written table, so that a bucket with a
third of all suffixes is never in one task.  This is not a suffix sort: the
README says why.

Stretches that say that windows repeat have 128-bit names of their bytes; those that
only say that they may have 64 bits.  A text is taken ``CHUNK`` windows at a time, so
memory does not grow with it beside the text itself.  Where a text repeats itself
with a short period, each anchor would be followed by another of the same windows;
those are found on the spot, and one of them stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytehash import Stretches, mix
from tessera.llm.scratch import Scratch

DEPTH = 200
WIDTH = 128  # windows an anchor can stand for, a power of two
Q = DEPTH - WIDTH + 1
BLOCKS = (16, 1)
CHUNK = 1 << 19
_BITS = WIDTH.bit_length() - 1
KEY = ["k", "j"]

_NAMES = ("c", "w", "v", *KEY, "at", "stop")
SUFFIX = pa.schema([(c, pa.int64()) for c in _NAMES])
SUFFIX_SQL = ", ".join(f"{c} long" for c in _NAMES)


def _pack(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An anchor and its windows: those that start ``low`` to ``high`` bytes before it."""
    return (anchor << (2 * _BITS)) | (low << _BITS) | high


def _unpack(at):
    return at >> (2 * _BITS), (at >> _BITS) & (WIDTH - 1), at & (WIDTH - 1)


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step < width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h


def _covering(view: memoryview, anchor: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of what covers the windows ``near`` to ``far`` bytes before the anchors, and of the anchor's place in it."""
    start, stop = np.maximum(anchor - far, 0), np.minimum(anchor - near + DEPTH, len(view))
    name = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([name(view[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    place = ((anchor - start).astype(np.uint64) << np.uint64(8)) ^ near.astype(np.uint64)
    return found[:, 0] + mix(place), found[:, 1]


def _alike(data: np.ndarray, h: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which anchors have the same windows as the one before them: the text repeats itself from there to here."""
    step = p[1:] - p[:-1]
    may = np.flatnonzero((h[1:] == h[:-1]) & (first[1:] - first[:-1] == step) & (last[1:] - last[:-1] == step))
    out = np.zeros(len(p), bool)
    for run in np.split(may, np.flatnonzero((np.diff(may) != 1) | (np.diff(step[may]) != 0)) + 1) if len(may) else ():
        r, a, b = int(step[run[0]]), int(first[run[0]]), int(last[run[-1]]) + DEPTH
        other = np.r_[0, np.cumsum(data[a:b] != data[a + r : b + r])]
        out[run + 1] = other[last[run] + DEPTH - a] == other[first[run] - a]
    return out


def _chosen(data: np.ndarray, chunk: int) -> Iterator[list[np.ndarray]]:
    """For each ``chunk`` windows: buckets and places of their anchors, and the first and last window of each.  An anchor is in one list only."""
    windows, held = len(data) - DEPTH + 1, None
    for begin in range(0, windows, chunk):
        part = data[begin : min(begin + chunk, windows) + DEPTH - 1]
        places = np.arange(len(part) - Q + 1)
        h = Stretches(part).ids(places, places + Q)
        keyed = (h & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)  # ties go to the leftmost
        at = (_sliding_least(keyed, WIDTH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        found = [h[at[first]], at[first] + begin, first + begin, last + begin]
        if held is not None:
            if held[1][0] == found[1][0]:  # its windows go on
                found[2][0] = held[2][0]
            else:
                found = [np.r_[x, y] for x, y in zip(held, found, strict=True)]
        held = [x[-1:] for x in found]
        yield [x[:-1] for x in found]
    if held is not None:
        yield held


def anchors(data: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """For each ``chunk`` windows of a text, the anchors: common and covering buckets and packed places; and the spans (start, stop) that repeat on the spot."""
    view = memoryview(data)
    for h, p, first, last in _chosen(data, chunk):
        again = _alike(data, h, p, first, last)
        local = again | np.r_[again, False][1:]
        start, stop = first[local], last[local] + DEPTH
        edge = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]]) if len(start) else np.zeros(0, np.int64)
        spans = np.stack([start[edge], np.r_[stop[edge[1:] - 1], stop[-1:]]], 1) if len(start) else np.zeros((0, 2), np.int64)
        h, p, low, high = h[~again], p[~again], (p - last)[~again], (p - first)[~again]
        yield h, *_covering(view, p, np.zeros_like(p), np.full_like(p, WIDTH - 1)), _pack(p, low, high), spans


def blocks(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The blocks of ``size`` windows of undecided anchors."""
    view = memoryview(data)
    p, low, high = _unpack(at)
    count = high // size - low // size + 1
    p, low, high = (np.repeat(x, count) for x in (p, low, high))
    block = low // size + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
    near, far = block * size, block * size + size - 1
    name = xxhash.xxh3_64_intdigest  # of what the windows have in common
    c = np.array([name(view[x:y]) for x, y in zip((p - near).tolist(), (p - far + DEPTH).tolist(), strict=True)], np.uint64) + mix(near.astype(np.uint64))
    return c, *_covering(view, p, near, far), _pack(p, np.maximum(low, near), np.minimum(high, far)), np.zeros((0, 2), np.int64)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        b = x.as_buffer() if x.is_valid else b""
        yield np.frombuffer(b, np.uint8) if len(b) else np.zeros(0, np.uint8)


def _batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of suffixes, and rows of spans (at, stop) that are decided."""
    held: list[list[np.ndarray]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        stop = columns.pop()
        return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in columns], pa.array(stop, mask=stop < 0)], schema=SUFFIX)

    for (c, w, v, at, spans), (k, j) in found:
        n, none = len(at), np.zeros(len(spans), np.uint64)
        held.append([np.r_[c, none], np.r_[w, none], np.r_[v, none], np.full(n + len(spans), k), np.full(n + len(spans), j), np.r_[at, spans[:, 0]], np.r_[np.full(n, -1), spans[:, 1]]])
        size += n + len(spans)
        if size > 100_000:
            yield emit()
            held.clear()
            size = 0
    if held:
        yield emit()


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(*[batch.column(c).to_pylist() for c in KEY], strict=True)


def _anchor_rows(chunk: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((found, key) for batch in batches for key, data in zip(_keys(batch), _bytes(batch.column("text")), strict=True) for found in anchors(data, chunk))

    return rows


def _block_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for key, data, at in zip(_keys(batch), _bytes(batch.column("text")), batch.column("open"), strict=True):
                    places = at.values.to_numpy(zero_copy_only=False)
                    for some in range(0, len(places), 20_000):
                        yield blocks(data, places[some : some + 20_000], size), key

        return _batched(each())

    return rows


def _decide(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (k, j, at, done, open) of the suffixes of ``rows`` that are not alone.

    ``done``: the block repeats as a whole.  ``open``: the next round looks at it.  That
    is each block that is not done, and, of blocks that are the same, one, since others
    of its bucket may have some of its windows.
    """
    rows = rows.where("stop is null").drop("stop")
    same = (F.min("w") == F.max("w")) & (F.min("v") == F.max("v"))
    buckets = rows.groupBy("c").agg(F.count("*").alias("n"), same.alias("same")).where("n > 1").drop("n")
    buckets = scratch.table(buckets, f"{name}-buckets")
    scratch.release()
    shared = scratch.table(rows.join(buckets, "c").drop("c"), f"{name}-shared")
    scratch.drop(f"{name}-buckets")
    scratch.release()
    here = F.struct(*KEY, "at")
    mixed = shared.where("not same").drop("same")
    covered = mixed.groupBy("w", "v").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    covered = scratch.table(covered.select("w", "v", "first"), f"{name}-covered")
    later = mixed.join(covered, ["w", "v"], "left").select(*KEY, "at", F.col("first").isNotNull().alias("done"), F.coalesce(here == F.col("first"), F.lit(True)).alias("open"))
    decided = scratch.table(shared.where("same").select(*KEY, "at", F.lit(True).alias("done"), F.lit(False).alias("open")).union(later), f"{name}-decided")
    scratch.drop(f"{name}-shared", f"{name}-covered")
    scratch.release()
    return decided


def _spans(decided: DataFrame) -> DataFrame:
    anchor, low, high = F.shiftright("at", 2 * _BITS), F.shiftright("at", _BITS).bitwiseAND(WIDTH - 1), F.col("at").bitwiseAND(WIDTH - 1)
    return decided.where("done").select(*KEY, F.struct((anchor - high).alias("start"), (anchor - low + DEPTH).alias("stop")).alias("span"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, data, spans in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), batch.column("spans"), strict=True):
            raw, runs = data.tobytes(), []
            if spans.is_valid:
                runs = merged(list(zip(spans.values.field("start").to_pylist(), spans.values.field("stop").to_pylist(), strict=True)))
            rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept(raw, runs)).hexdigest(), "spans": [{"start": a, "stop": b} for a, b in runs]})
        yield pa.RecordBatch.from_pylist(rows, schema=OUT)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by a 128-bit key of id and text: rows that are equal in both have equal spans, and find each other."""
    text: Column = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text, F.octet_length(text)).alias("k"), F.xxhash64(F.lit(1), text, "doc_id").alias("j"))


def find_repeats(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(k, j, spans): the stretches of every document that are covered by repeated strings."""
    keyed = _keyed(docs).where(F.octet_length("text") >= DEPTH)
    rows = scratch.table(keyed.select(*KEY, "text").mapInArrow(_anchor_rows(chunk), SUFFIX_SQL), "anchors-rows")
    local = scratch.table(rows.where("stop is not null").select(*KEY, F.struct(F.col("at").alias("start"), "stop").alias("span")), "local")
    decided = _decide(rows, scratch, "anchors")
    scratch.drop("anchors-rows")
    found = local.union(_spans(decided))
    for size in BLOCKS:
        # rows that are equal in id and text come with the same anchors twice: once is enough, and each row counts
        still = decided.where("open").groupBy(*KEY).agg(F.collect_set("at").alias("open"))
        texts = keyed.join(still, KEY).select(*KEY, "text", "open")
        rows = scratch.table(texts.mapInArrow(_block_rows(size), SUFFIX_SQL), f"blocks-{size}-rows")
        decided = _decide(rows, scratch, f"blocks-{size}")
        scratch.drop(f"blocks-{size}-rows")
        found = found.union(_spans(decided))
    return found.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Cut every byte that is covered by a 200-byte string that also starts anywhere else.

    Texts are their UTF-8 bytes; matches do not cross documents but may lie in the
    same one and overlap.  One row a document: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and the spans.  A null text is empty; a text under 200 bytes keeps
    all; of equal texts, repeated rows included, each loses every byte.  An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = scratch.table(find_repeats(docs, scratch, chunk), "spans")
    scratch.release()
    return _keyed(docs).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_cut, OUT_SQL)
