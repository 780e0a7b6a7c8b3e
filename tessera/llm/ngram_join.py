"""Jaccard join on word n-grams (operator 6).

The join is the sparse product D * D' of the document by n-gram incidence,
computed in blocks.  N-grams are dealt into column blocks by their hashes.  The
sizes of two linked sets bound how many n-grams can differ: at least the share t
of the union is common, so at most (1 - t) / t of the smaller set differ.  With
one block more than that, a linked pair agrees in a whole block.  Documents
that agree in a column block form a row block; all other entries of the product
are below the bound and are not computed.  In a row block the overlap is
accumulated one column block after the other, and a pair is discarded as soon as
what is left cannot lift it to its bound.

Row blocks may hold large groups of near copies, so not all pairs of one are
formed.  What matters are links between different components of a row block.
Where few of its sets are outside its largest component, those are held against
all of its sets.  Elsewhere some hubs are held against all sets, and the links found
join components before the next hubs are chosen.  After ``ROUNDS`` rounds, or when
hubs no longer join anything, all pairs of different components are held against
each other, so no link between two components is lost.  The pairs of rounds of hubs
are in proportion to the listings; what is left then are large groups that are alike
but not linked, and its time grows with the square of such a group.  Pairs must pass bounds on sizes and on parities
of n-gram counts before they become rows.

A passage or an n-gram that unrelated documents share makes a row block that grows
with the corpus.  A linked pair agrees in all blocks but those that can differ, so
a set with m + 1 blocks more than can differ may leave out the m that most sets
share: if all sets rank blocks alike, the rarest that a pair agrees in has m others
above it in both, and neither set leaves it out.
Sets are nodes: copies of one set never form pairs.

Links are counted apart: both ends of a link lie in one component, so the sets of
each component are dealt into blocks and the product of each pair of blocks is
computed whole.  Only sums for each set leave a product, never pairs, but the time
it takes grows with the square of the different sets of a component.

Sets are told apart by 128 bits of hashes of their sorted n-grams, rows by 128 bits
of id and text.  N-grams are 64-bit hashes, and a pair is decided on all of them, so
a wrong decision takes two different n-grams of the same two documents with one hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytehash import mix
from tessera.llm.components import components
from tessera.llm.rows import unwrapped, wrapped
from tessera.llm.scratch import Scratch, partitions
from tessera.llm.shingles import raw, sets, slices

CLASS_RATIO = 1.5
MOST_SPARED = (1 << 15) - 1
COLUMN_BLOCKS = 8
LISTINGS = 4  # parts of the column blocks that are taken one after the other, to bound the disk in use
PASSES = 4  # the same for pairs, if there are more than PASS_PAIRS
PASS_PAIRS = 20_000
FEW_PAIRS = 1000  # candidates that are all verified at once
BROADCAST_IDS = 1_000_000
OUTSIDE = 8  # sets of a row block outside its largest component that are held against all of its sets at once
HUBS = 8  # else, hubs of a row block in each round
ROUNDS = 2  # rounds of hubs, before the sets outside the largest component are held against all
CELL_SETS = 1024  # hubs of a row block that one task holds against its sets
BLOCK_SETS = 512  # sets and n-grams, on average, of a block of one component whose links are counted
BLOCK_GRAMS = 1 << 18
DENSE = 64  # an n-gram is multiplied as a dense column if this part of the block's pairs, or more, share it


class Bounds:
    """What a threshold ``t`` says about the sizes and the differences of linked sets."""

    def __init__(self, t: Fraction):
        self.t = t
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * CLASS_RATIO)))
        self.edges = np.array(edges)

    def differing(self, n: int) -> int:
        """Most n-grams that a set of ``n`` and a linked one that is not smaller have not in common."""
        return n * (self.t.denominator - self.t.numerator) // self.t.numerator

    def parts(self, cls: int) -> int:
        """Column blocks of a size class: one more than can differ, and as many as are likely to be empty."""
        largest = int(self.edges[cls + 1]) - 1
        needed = self.differing(largest) + 1
        empty = needed * math.exp(-largest / needed)
        return needed + math.ceil(empty + 3 * math.sqrt(empty)) if needed > 1 else 1

    def classes(self, n: int) -> list[tuple[int, int]]:
        """(size class, number of column blocks) under which a set of ``n`` is listed: its own and those of smaller sets."""
        least = -(-n * self.t.numerator // self.t.denominator)
        own, low = (int(np.searchsorted(self.edges, x, "right")) - 1 for x in (n, max(1, least)))
        return [(c, self.parts(c)) for c in range(low, own + 1)]


def signatures(u: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Identifiers of the column blocks of a sorted set."""
    return listings(u, bounds)[0]


def listings(u: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, int]:
    """Identifiers of the column blocks of a sorted set, and how many of them it can spare.

    The two low bits of an identifier are those of the size class.  The set can do
    without as many of a class as ``spared`` reads from the second result.

    A block without n-grams says nothing and is left out.  If there are so few others
    that a linked set may differ in each, the blocks less one n-gram are listed too:
    then a block in which the pair differs by one is the same in both.  If even that
    can fail (each block of one n-gram differs by one, and each larger one by two),
    which takes a tiny set with most blocks empty, one identifier for all such sets
    of the size class is added.
    """
    out, high = [], u >> np.uint64(32)
    spare: dict[int, int] = {}
    for cls, parts in bounds.classes(len(u)):
        part = (high * np.uint64(parts)) >> np.uint64(32)
        begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        spread = mix(u)
        sums = np.add.reduceat(spread, begins)
        salt = mix(part[begins] + np.uint64((cls << 40) + 1))
        found = [mix(sums ^ salt)]
        most = min(bounds.differing(len(u)), bounds.differing(int(bounds.edges[cls + 1]) - 1))
        if len(begins) <= most:
            which = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(u)]))
            less = sums[which] - spread
            found.append(mix(less[less != 0] ^ salt[which][less != 0]))
            if len(begins) + np.count_nonzero(np.diff(np.r_[begins, len(u)]) > 1) <= most:
                found.append(mix(np.array([(cls << 40) + 2], np.uint64)))
        out.append((np.concatenate(found) & ~np.uint64(3)) | np.uint64(cls & 3))
        m = min(MOST_SPARED, max(0, len(begins) - most - 1))
        spare[cls & 3] = min(m, spare.get(cls & 3, m))
    return np.unique(np.concatenate(out)), sum(m << 16 * low for low, m in spare.items())


def spared(spare: Column, sig: Column) -> Column:
    """How many identifiers of the class of ``sig`` a set can do without."""
    low = sig.bitwiseAND(F.lit(3))
    return F.coalesce(*[F.when(low == c, F.shiftright(spare, 16 * c).bitwiseAND(F.lit(MOST_SPARED))) for c in range(4)])


def parities(u: np.ndarray, bits: int) -> np.ndarray:
    """Parities of n-gram counts: two sets differ in at least as many n-grams as parities.  Half as many are the exclusive or of both halves."""
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_bits(n: int) -> int:
    """A power of two that grows with the set, as fewer parities would say nothing of the difference of large sets."""
    return max(256, 1 << (n - 1).bit_length())


_KEYS = ("k", "j", "n", "s", "z", "p0", "p1", "p2", "p3", "spare")
_SIGS = tuple(f"sig_{g}" for g in range(LISTINGS))
ENTRY = pa.schema([*[(c, pa.int64()) for c in _KEYS], *[(c, pa.list_(pa.int64())) for c in ("wide", *_SIGS)]])
ENTRY_SQL = ", ".join([*[f"{c} long" for c in _KEYS], *[f"{c} array<long>" for c in ("wide", *_SIGS)]])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _listed(width: int, t: Fraction):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, none = Bounds(t), np.zeros(0, np.int64)
        edges = np.array([(g << 64) // LISTINGS for g in range(1, LISTINGS)], np.uint64)
        for batch in batches:
            keys = iter(zip(batch.column("k").to_pylist(), batch.column("j").to_pylist(), strict=True))
            for texts in slices(raw(batch.column("text"))):
                numbers, lists = [], []
                for u in sets(texts, width):
                    k, j = next(keys)
                    if not len(u):
                        numbers.append((k, j, *[0] * 8))
                        lists.append([none] * (1 + LISTINGS))
                        continue
                    s = int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes())).astype(np.int64))
                    z = int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes(), 1)).astype(np.int64))
                    wide = parities(u, wide_bits(len(u)))
                    short = np.bitwise_xor.reduce(wide.reshape(-1, 4), axis=0)
                    found, spare = listings(u, bounds)
                    numbers.append((k, j, len(u), s, z, *short.tolist(), spare))
                    lists.append([wide, *np.split(found.view(np.int64), np.searchsorted(found, edges))])
                columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)] + [_lists(list(c)) for c in zip(*lists, strict=True)]
                yield pa.record_batch(columns, schema=ENTRY)

    return rows


def _rows_of(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = iter(batch.column("id").to_pylist())
            for texts in slices(raw(batch.column("text"))):
                found = [u.view(np.int64) for u in sets(texts, width)]
                yield pa.record_batch([pa.array([next(ids) for _ in found], pa.int64()), _lists(found)], names=["id", "grams"])

    return rows


def overlaps(a: list[np.ndarray], b: list[np.ndarray], t: Fraction) -> np.ndarray:
    """Which pairs of sorted sets are linked: overlap counts over column blocks, with pairs below their bound discarded."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # 100 * common >= 90 * union is common * (num + den) >= num * (na + nb)
    need = -(-(na + nb) * t.numerator // (t.numerator + t.denominator))
    edges = np.array([(i << 64) // COLUMN_BLOCKS for i in range(1, COLUMN_BLOCKS)], np.uint64)
    cut = lambda x: np.r_[0, np.searchsorted(x, edges), len(x)]
    cuts_a, cuts_b = np.array([cut(x) for x in a]), np.array([cut(x) for x in b])
    common, alive = np.zeros(len(a), np.int64), np.minimum(na, nb) >= need
    for j in range(COLUMN_BLOCKS):
        active = np.flatnonzero(alive)
        if not len(active):
            break
        x = [a[i][cuts_a[i, j] : cuts_a[i, j + 1]] for i in active] + [b[i][cuts_b[i, j] : cuts_b[i, j + 1]] for i in active]
        pair = np.repeat(np.r_[active, active], [len(y) for y in x])
        grams = np.concatenate(x)
        order = np.lexsort((grams, pair))
        pair, grams = pair[order], grams[order]
        twice = (pair[1:] == pair[:-1]) & (grams[1:] == grams[:-1])
        common += np.bincount(pair[1:][twice], minlength=len(a))
        alive &= common + np.minimum(na - cuts_a[:, j + 1], nb - cuts_b[:, j + 1]) >= need
    return alive & (common >= need)


def _product(t: Fraction):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [[x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(c)] for c in ("ga", "gb")]
            for at in range(0, batch.num_rows, 1000):
                linked = overlaps(grams[0][at : at + 1000], grams[1][at : at + 1000], t)
                yield batch.slice(at, 1000).select(["a", "b"]).filter(pa.array(linked))

    return rows


def common_counts(la: np.ndarray, ga: np.ndarray, lb: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """How many n-grams each set of one block has in common with each of another (sizes of the sets, n-grams one set after the other)."""
    na, nb = len(la), len(lb)
    row_a, row_b = np.repeat(np.arange(na), la), np.repeat(np.arange(nb), lb)
    grams, column = np.unique(np.concatenate([ga, gb]), return_inverse=True)
    col_a, col_b = column[: len(ga)], column[len(ga) :]
    in_a, in_b = np.bincount(col_a, minlength=len(grams)), np.bincount(col_b, minlength=len(grams))
    pairs, out = in_a * in_b, np.zeros((na, nb), np.int64)
    dense = pairs * DENSE >= na * nb
    many = np.flatnonzero(dense)
    for at in range(0, len(many), 4096):
        place = np.full(len(grams), -1)
        place[many[at : at + 4096]] = np.arange(len(many[at : at + 4096]))
        sides = []
        for n, row, col in ((na, row_a, col_a), (nb, row_b, col_b)):
            x, some = np.zeros((n, len(many[at : at + 4096])), np.float32), place[col] >= 0
            x[row[some], place[col[some]]] = 1
            sides.append(x)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    some = np.flatnonzero(((pairs > 0) & ~dense)[col_a])
    row_b, begins = row_b[np.argsort(col_b, kind="stable")], np.r_[0, np.cumsum(in_b)]
    ends = np.cumsum(in_b[col_a[some]])
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
        rows, cols = row_a[some[at:stop]], col_a[some[at:stop]]
        n = in_b[cols]
        each = np.repeat(begins[cols], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(rows, n) * nb + row_b[each], minlength=na * nb).reshape(na, nb)
        at = stop
    return out


def _block(members: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Identifiers, weights and sizes of the sets of a block, and their n-grams one set after the other."""
    s, w, grams = members.flatten()
    return s.to_numpy(), w.to_numpy(), np.diff(grams.offsets.to_numpy()), grams.flatten().to_numpy()


def _sums(t: Fraction, *sides: str):
    """For each set of one or two blocks of a component, the weights of the sets of the other, or of the same one, that it is linked with."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                blocks = [_block(batch.column(c)[i].values) for c in sides]
                (sa, wa, la, ga), (sb, wb, lb, gb) = blocks[0], blocks[-1]
                linked = common_counts(la, ga, lb, gb) * (t.numerator + t.denominator) >= (la[:, None] + lb[None, :]) * t.numerator
                if len(sides) == 1:
                    np.fill_diagonal(linked, False)
                else:
                    ids.append(sb)
                    sums.append(wa @ linked)
                ids.append(sa)
                sums.append(linked @ wb)
            yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums))], names=["id", "links"])

    return rows


def may_link(na: np.ndarray, wa: np.ndarray, nb: np.ndarray, wb: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs sizes and wide parities (a row a set, as many words in each of ``wa`` and in each of ``wb``) do not rule out."""
    words = min(wa.shape[1], wb.shape[1])
    wa, wb = (np.bitwise_xor.reduce(w.reshape(len(w), -1, words), axis=1) for w in (wa, wb))
    small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    out = small * t.denominator >= large * t.numerator
    step = max(1, (1 << 20) // max(1, len(nb) * words))
    for at in range(0, len(na), step):
        odd = np.bitwise_count(wa[at : at + step, None, :] ^ wb[None, :, :]).sum(axis=2, dtype=np.int64)
        n = na[at : at + step, None] + nb[None, :]
        out[at : at + step] &= (n - odd) * (t.numerator + t.denominator) >= n * 2 * t.numerator
    return out


def _may_link(t: Fraction, *sides: str):
    """Pairs (a, b) of sets (id, c, n, wide) of one or two blocks that are in different components and may be linked."""

    def parts(members: pa.StructArray) -> list[tuple[np.ndarray, ...]]:
        ids, c, n, wide = members.flatten()
        words, flat = np.diff(wide.offsets.to_numpy()), wide.flatten().to_numpy().view(np.uint64)
        begins, out = np.cumsum(words) - words, []
        for m in np.unique(words):
            some = words == m
            out.append((ids.to_numpy()[some], c.to_numpy()[some], n.to_numpy()[some], flat[begins[some][:, None] + np.arange(m)]))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [parts(batch.column(c)[i].values) for c in sides]
                for x, (ia, ca, na, wa) in enumerate(blocks[0]):
                    for ib, cb, nb, wb in blocks[-1][x if len(sides) == 1 else 0 :]:
                        a, b = np.nonzero((ca[:, None] != cb[None, :]) & may_link(na, wa, nb, wb, t))
                        a, b = ia[a], ib[b]
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows


MEMBER, EDGE, PAIR = 0, 1, 2


def _runs(small: int):
    """Of sorted listings (sig, s), what their blocks give, as rows (kind, x, y).

    PAIR: both sets of each pair of a block of at most ``small`` sets.  MEMBER: the sig and a
    set of a larger block, or of one that may go on in the partition before or after.
    EDGE: the same where the partition has only one set of such a block.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, s = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last run, which may go on
        told, begun = False, False  # whether that run was told as members but for rows to come; whether a run has ended
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            kind = np.repeat(np.array([k for k, _, _ in out], np.int8), [len(x) for _, x, _ in out])
            none = np.zeros(0, np.int64)
            x, y = (np.concatenate([none, *[o[i] for o in out]]) for i in (1, 2))
            out.clear()
            return pa.record_batch([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig, s = np.r_[sig, batch.column("sig").to_numpy()], np.r_[s, batch.column("s").to_numpy()]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (s[1:] != s[:-1])]
            sig, s = sig[new], s[new]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            n = np.diff(np.r_[start, len(sig)])
            ended = np.arange(len(start) - 1)
            if len(ended) and (told or not begun):  # the first run is the partition's first, or is told already
                if told:
                    out.append((MEMBER, sig[1 : n[0]], s[1 : n[0]]))
                else:
                    out.append((EDGE if n[0] == 1 else MEMBER, sig[: n[0]], s[: n[0]]))
                ended, told, begun = ended[1:], False, True
            for m in range(2, small + 1):
                block = s[start[ended[n[ended] == m]][:, None] + np.arange(m)]
                i, j = np.triu_indices(m, 1)
                out.append((PAIR, block[:, i].ravel(), block[:, j].ravel()))
            large = np.zeros(len(start), bool)
            large[ended[n[ended] > small]] = True
            some = np.repeat(large, n)
            out.append((MEMBER, sig[some], s[some]))
            sig, s = sig[start[-1] :], s[start[-1] :]
            if told:  # the run goes on; its first row is told
                out.append((MEMBER, sig[1:], s[1:]))
                sig, s = sig[-1:], s[-1:]
            elif len(sig) > small:
                out.append((MEMBER, sig, s))
                sig, s, told = sig[-1:], s[-1:], True
            yield emit()
        if len(sig) and not told:
            out.append((EDGE if len(sig) == 1 else MEMBER, sig, s))
            yield emit()

    return rows


class Join:
    """One run of the join over ``rows`` (k, j: a key of the row, text)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, width: int, t: Fraction):
        self.rows, self.scratch, self.width, self.t = rows, scratch, width, t
        self.entries = scratch.table(rows.mapInArrow(_listed(width, t), ENTRY_SQL), "entries")
        # a row for each set: an id, the least key, its size and its parities
        first = [F.first(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3", "spare", "wide")]
        some = self.entries.where("n > 0").groupBy("s", "z").agg(F.min(F.struct("k", "j")).alias("key"), F.count("*").alias("rows"), *first)
        self.sets = scratch.table(some.select(F.monotonically_increasing_id().alias("id"), "key.k", "key.j", *[c for c in some.columns if c != "key"]), "sets")
        self.keys = scratch.table(self.entries.select("k", "j", "n", "s", "z"), "keys")
        self.repeated = not self.keys.groupBy("k", "j").count().where("count > 1").isEmpty()
        self.grams: DataFrame | None = None  # (id, grams) of the sets that were fetched

    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of the sets of small row blocks that may be linked, and (sig, id, n, p0 ..), the sets of each larger one.

        Listings are sorted by ranges of (sig, s), so one shuffle shows the blocks, and a
        block with a third of all sets lies in many ranges.
        """
        scratch, n, runs = self.scratch, partitions(self.scratch.spark), None
        for g in range(LISTINGS):
            listed = self.entries.where("n > 0").select(F.explode(f"sig_{g}").alias("sig"), "s")
            some = listed.repartitionByRange(n, "sig", "s").sortWithinPartitions("sig", "s").mapInArrow(_runs(OUTSIDE + 1), "kind byte, x long, y long")
            some = scratch.table(some, f"runs-{g}")
            runs = some if runs is None else runs.union(some)
            scratch.release()
        scratch.drop("entries")
        found = runs.where(F.col("kind") != PAIR).select(F.col("x").alias("sig"), F.col("y").alias("s"), "kind")
        # at most two sets a range are edges; they stay if another range has another set of their block
        edges = found.where(F.col("kind") == EDGE).select("sig", "s")
        shared = found.join(F.broadcast(edges.select("sig").distinct()), "sig").groupBy("sig").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x != y").select("sig")
        members = found.where(F.col("kind") == MEMBER).select("sig", "s").union(edges.join(F.broadcast(shared), "sig").distinct())
        members = scratch.table(members, "listed")
        attributes = ["id", "n", "p0", "p1", "p2", "p3"]
        members = scratch.table(self._rarest(members, attributes), "members")
        side = lambda c: self.sets.select(F.col("s").alias(c), *[F.col(x).alias(f"{c}{x}") for x in attributes])
        odd = sum((F.bit_count(F.col(f"xp{i}").bitwiseXOR(F.col(f"yp{i}"))) for i in range(4)), F.lit(0))
        near = runs.where(F.col("kind") == PAIR).select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y").where(self._possible(F.col("xn"), F.col("yn"), odd) & (F.col("xid") != F.col("yid")))
        near = scratch.table(near.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")), "near")
        scratch.drop("listed", "shares", *[f"runs-{g}" for g in range(LISTINGS)])
        scratch.release()
        return near, members

    def _rarest(self, members: DataFrame, attributes: list[str]) -> DataFrame:
        """(sig, attributes) of ``members`` (sig, s) but for those that a set can spare, the ones that most sets share."""
        shares = self.scratch.table(members.groupBy("sig").agg(F.count("*").alias("shares")).where("shares > 1"), "shares")
        named = members.join(shares, "sig").join(self.sets.select("s", "spare", *attributes), "s")
        # s as well: the join has dealt by it
        alike = Window.partitionBy("s", "id", F.col("sig").bitwiseAND(F.lit(3))).orderBy(F.desc("shares"), "sig")
        ranked = named.withColumn("rank", F.row_number().over(alike))
        return ranked.where(F.col("rank") > spared(F.col("spare"), F.col("sig"))).select("sig", *attributes)

    def _possible(self, na: Column, nb: Column, odd: Column) -> Column:
        """Whether sizes and a number of n-grams that differ at least leave room for a link."""
        num, den = self.t.numerator, self.t.denominator
        # with d n-grams that differ: common = (na + nb - d) / 2
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & ((na + nb - odd) * (num + den) >= (na + nb) * 2 * num)

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the keys of both sets whose sizes and parities do not rule out a link."""
        side = lambda c: self.sets.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"), F.col("j").alias(f"j{c}"), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"wide{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        size = F.least(F.size("widea"), F.size("wideb"))

        def folded(x: str) -> Column:  # sizes of linked sets are within a factor of two
            return F.when(F.size(x) == size, F.col(x)).otherwise(F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q)))

        odd = F.aggregate(F.zip_with(folded("widea"), folded("wideb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        return both.where(self._possible(F.col("na"), F.col("nb"), odd)).select("a", "ka", "ja", "b", "kb", "jb")

    def fetch(self, wanted: DataFrame, name: str) -> DataFrame:
        """(id, grams) for each of ``wanted`` (id, k, j: a key of the set) and those that were fetched before."""
        if self.grams is not None:
            wanted = wanted.join(self.grams.select("id"), "id", "left_anti")
        wanted = self.scratch.table(wanted, f"{name}-wanted")
        n = wanted.count()
        if n or self.grams is None:
            # rows of one key have one text: any of them stands for the set
            texts = self.rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["k", "j"]).select("id", "text")
            found = texts.mapInArrow(_rows_of(self.width), "id long, grams array<long>")
            found = self.scratch.table(found.dropDuplicates(["id"]) if self.repeated else found, f"{name}-grams")
            self.grams = found if self.grams is None else self.grams.union(found)
        self.scratch.drop(f"{name}-wanted")
        return self.grams

    def _verify(self, candidates: DataFrame, name: str) -> DataFrame:
        """Links (a, b) among the candidates that join all that the candidates' links join.

        Each set is held against the least one it is a candidate with; of the other
        candidates those remain that lie in different components then.
        """
        scratch = self.scratch
        wanted = candidates.select(F.col("a").alias("id"), F.col("ka").alias("k"), F.col("ja").alias("j")).union(candidates.select("b", "kb", "jb")).distinct()
        grams, pairs = self.fetch(wanted, name), candidates.select("a", "b")
        if pairs.count() <= FEW_PAIRS:
            return self._linked(pairs, grams, name)
        least = scratch.table(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"{name}-least")
        links = self._linked(least, grams, f"{name}-least")
        found = components(links, scratch, f"{name}-merge")
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        rest = pairs.join(least, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = scratch.table(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), f"{name}-rest")
        return links.union(self._linked(rest, grams, name))

    def _linked(self, pairs: DataFrame, grams: DataFrame, name: str) -> DataFrame:
        """The ``pairs`` (a, b) that are linked."""
        n, links = pairs.count(), None
        passes = PASSES if n > PASS_PAIRS else 1
        for g in range(passes):  # the rows of one pass are on disk at a time
            some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == g)

            def side(c: str) -> DataFrame:
                ids = some.select(F.col(c).alias("id")).distinct()  # noqa: B023
                held = grams.join(F.broadcast(ids), "id", "left_semi") if n <= BROADCAST_IDS else grams
                return held.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}"))

            both = some.join(side("a"), "a").join(side("b"), "b")
            out = self.scratch.table(both.mapInArrow(_product(self.t), "a long, b long"), f"{name}-links-{g}")
            links = out if links is None else links.union(out)
            self.scratch.release()
        return links

    def _pairs(self, named: DataFrame, hubs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of a hub and a set of its row block in another component that may be linked."""
        marks = [F.col(x).alias(f"h{x}") for x in ("id", "c", "n", "p0", "p1", "p2", "p3")]
        cells = F.ceil(F.col("held") / CELL_SETS).cast("int")
        left = named.withColumn("cell", F.pmod(F.xxhash64("id"), cells).cast("int"))
        right = hubs.select("sig", *marks, F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
        odd = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"hp{i}"))) for i in range(4)), F.lit(0))
        near = left.join(right, ["sig", "cell"]).where((F.col("c") != F.col("hc")) & self._possible(F.col("n"), F.col("hn"), odd))
        return near.select(F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")).distinct()

    def _rest(self, open_: DataFrame, name: str) -> DataFrame:
        """Distinct pairs (a, b) of sets in different components that share a row block and may be linked.

        Near copies share many row blocks, and each would give the same pairs.  Sets that
        row blocks tie together are therefore multiplied once, by their wide parities, where
        that makes fewer pairs than the row blocks together; elsewhere row blocks give the pairs.
        """
        scratch = self.scratch
        blocks = scratch.table(open_.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("all"), F.first("outside").alias("outside")), f"{name}-blocks")
        ties = open_.join(blocks.select("sig", "least"), "sig").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
        tied = scratch.table(components(ties, scratch, f"{name}-ties"), f"{name}-tied")
        cells = tied.groupBy(F.col("component").alias("cell")).agg(F.count("*").alias("sets"))
        costs = blocks.join(tied, blocks["least"] == tied["node"]).groupBy(F.col("component").alias("cell")).agg(F.sum(F.col("all") * F.col("outside")).alias("pairs"))
        once = scratch.table(cells.join(costs, "cell").where(F.col("sets") * F.col("sets") <= F.col("pairs")).select("cell"), f"{name}-once")
        where = scratch.table(tied.join(once, tied["component"] == once["cell"]).select(F.col("node").alias("id"), "cell"), f"{name}-cells")
        named = open_.select("id", "c").distinct().join(where, "id").join(self.sets.select("id", "n", "wide"), "id")
        named = scratch.table(named, f"{name}-sets")
        size = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS))
        dealt = named.join(scratch.table(named.groupBy("cell").agg(size.alias("blocks")), f"{name}-sizes"), "cell").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
        packed = scratch.table(dealt.groupBy("cell", "blocks", "i").agg(F.collect_list(F.struct("id", "c", "n", "wide")).alias("a")), f"{name}-packed")
        pairs = packed.select("a").mapInArrow(_may_link(self.t, "a"), "a long, b long")
        left = packed.where("i + 1 < blocks").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)))
        right = packed.where("blocks > 1").select("cell", F.col("i").alias("j"), F.col("a").alias("b"))
        pairs = pairs.union(left.join(right, ["cell", "j"]).select("a", "b").mapInArrow(_may_link(self.t, "a", "b"), "a long, b long"))
        others = scratch.table(open_.join(where.select("id"), "id", "left_anti"), f"{name}-others")
        if not others.isEmpty():
            pairs = pairs.union(self._pairs(others, others.where("c != big")))
        return pairs.distinct()

    def classes(self) -> DataFrame:
        """(node, component): the component, named by its least set, of each set that has links."""
        scratch, found, tested, last = self.scratch, None, None, False
        near, members = self._blocks()
        for round_ in range(ROUNDS + 1):
            last = last or round_ == ROUNDS
            named = members.withColumn("c", F.col("id")) if found is None else members.join(found.withColumnsRenamed({"node": "id", "component": "c"}), "id", "left").withColumn("c", F.coalesce("c", "id"))
            named = scratch.table(named, f"named-{round_}")
            in_one = named.groupBy("sig", "c").agg(F.count("*").alias("m"))
            sizes = in_one.groupBy("sig").agg(F.sum("m").alias("all"), F.max("m").alias("m"), F.max_by("c", "m").alias("big")).withColumn("outside", F.col("all") - F.col("m")).where("outside > 0")
            blocks = scratch.table(sizes.select("sig", "big", "outside", F.when((F.col("outside") <= OUTSIDE) | F.lit(last), F.col("outside")).otherwise(HUBS).alias("held"), ((F.col("outside") > OUTSIDE) & ~F.lit(last)).alias("large")), f"sizes-{round_}")
            open_ = scratch.table(named.join(blocks, "sig"), f"open-{round_}")
            large = open_.where("large")
            deal = F.xxhash64("id", F.lit(round_))  # other hubs in each round
            chosen = large.groupBy("sig", F.pmod(deal, F.lit(HUBS)).alias("part")).agg(F.min("id").alias("id")).drop("part")
            chosen = scratch.table(chosen, f"hubs-{round_}")
            hubs = open_.where("not large and c != big").unionByName(large.join(chosen, ["sig", "id"]))
            pairs = self._rest(open_, f"rest-{round_}") if last else self._pairs(open_, hubs)
            pairs = scratch.table(pairs if round_ else pairs.union(near).distinct(), f"pairs-{round_}")
            candidates = self._candidates(pairs)
            if tested is not None:
                candidates = candidates.join(tested, ["a", "b"], "left_anti")
            candidates = scratch.table(candidates, f"candidates-{round_}")
            links = self._verify(candidates, f"round-{round_}")
            tested = candidates.select("a", "b") if tested is None else tested.union(candidates.select("a", "b"))
            more = not links.isEmpty()
            if more:
                found = self._joined(found, links, round_)
            done = large.isEmpty()
            if not done:
                members = large.select("sig", "id", "n", "p0", "p1", "p2", "p3")
            scratch.drop(*[f"{x}-{round_}" for x in ("named", "sizes", "hubs", "pairs")], *([f"open-{round_ - 1}"] if round_ else ["members", "near"]))
            scratch.release()
            if done:
                break
            last = not more  # hubs do not help any more
        return found if found is not None else scratch.spark.createDataFrame([], "node long, component long")

    def _joined(self, found: DataFrame | None, links: DataFrame, round_: int) -> DataFrame:
        """``found`` after ``links`` have joined components."""
        scratch = self.scratch
        if found is not None:
            name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            links = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = scratch.table(components(links, scratch, f"merge-{round_}"), f"merged-{round_}")
        if found is None:
            return merged
        named = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return scratch.table(named.union(merged.join(found, "node", "left_anti").select("node", "component")), f"found-{round_}")

    def links(self, found: DataFrame) -> DataFrame:
        """(id, links): for each set with links, the rows of the other sets that it is linked with; ``found`` is what classes() gave."""
        scratch = self.scratch
        sized = scratch.table(found.withColumnRenamed("node", "id").join(self.sets.select("id", "k", "j", "n", "rows"), "id"), "sized")
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS))
        blocks = scratch.table(sized.groupBy("component").agg(blocks.alias("blocks")), "counted")
        dealt = sized.join(blocks, "component").select("id", "rows", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("i"))
        grams = self.fetch(sized.select("id", "k", "j"), "links")
        packed = grams.join(dealt, "id").groupBy("component", "blocks", "i").agg(F.collect_list(F.struct("id", "rows", "grams")).alias("a"))
        packed = scratch.table(packed, "packed")
        scratch.release()
        sums = scratch.table(packed.select("a").mapInArrow(_sums(self.t, "a"), "id long, links long"), "sums")
        left = packed.where("i + 1 < blocks").withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)))
        right = packed.where("blocks > 1").select("component", F.col("i").alias("j"), F.col("a").alias("b"))
        for g in range(PASSES):  # the pairs of blocks of one pass are on disk at a time
            cells = left.where(F.pmod(F.xxhash64("component", "i", "j"), F.lit(PASSES)) == g).select("component", "j", "a")
            some = cells.join(right, ["component", "j"]).select("a", "b").mapInArrow(_sums(self.t, "a", "b"), "id long, links long")
            sums = sums.union(scratch.table(some.groupBy("id").agg(F.sum("links").alias("links")), f"sums-{g}"))
            scratch.release()
        sums = scratch.table(sums.groupBy("id").agg(F.sum("links").alias("links")), "all-sums")
        scratch.drop("packed", "sized", "counted", "sums", *[f"sums-{g}" for g in range(PASSES)])
        return sums


def keyed(docs: DataFrame) -> DataFrame:
    """_k and _j, together a 128-bit key of id and text, for each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_k": F.xxhash64("doc_id", text, F.octet_length(text)), "_j": F.xxhash64(F.lit(1), text, "doc_id")})


def classify_keys(rows: DataFrame, scratch: Scratch, width: int, t: Fraction, counted: bool = False) -> DataFrame:
    """(k, j, id, copies, _n, _class) for each distinct key of ``rows`` (k, j, text, id), and _links if ``counted``.

    _n is the size of the set.  Keys of one class reach each other by links or have
    one set; sets without n-grams have the null class and are linked with nothing.
    ``copies`` is the number of rows of the key, which are equal in id and text.
    _links is the number of other rows that a row of the key is linked with.
    """
    join = Join(rows.select("k", "j", "text"), scratch, width, t)
    found = join.classes()
    classes = join.sets.select("id", "s", "z", "rows").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("_class", F.coalesce("component", "id"))
    if counted:
        classes = classes.join(join.links(found), "id", "left")
    ids = rows.groupBy("k", "j").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
    entries = join.keys.select("k", "j", F.col("n").alias("_n"), "s", "z").dropDuplicates(["k", "j"]).join(ids, ["k", "j"])
    # sets without n-grams have s = z = 0 and no row in ``sets``
    named = entries.join(classes.drop("id"), [entries["s"] == classes["s"], entries["z"] == classes["z"], entries["_n"] > 0], "left")
    columns = ["k", "j", "id", "copies", "_n", "_class"]
    if counted:
        named = named.withColumn("_links", F.coalesce(F.col("rows") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)))
        columns.append("_links")
    out = scratch.table(named.select(*columns), "named-keys")
    scratch.drop("keys", "sets")
    return out


def link_documents(docs: DataFrame, width: int = 3, t: Fraction = Fraction(9, 10)) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, n_links.

    The component is the smallest doc_id that links reach, the document's own
    included; documents with equal sets are linked.  n_links is the number of other
    rows that the document is linked with: every link counts, those between members
    of one component too, and rows that are equal in id and text count each.  A null
    text, an empty one and one of white space have no shingles and are linked with
    nothing.  Repeated rows give repeated results; rows without an id can be in a
    component and have none of their own if alone.  An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "linked")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    classed = classify_keys(rows.select(F.col("_k").alias("k"), F.col("_j").alias("j"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id")), scratch, width, t, True)
    least = classed.where("_class is not null").groupBy("_class").agg(F.min("id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = scratch.table(least, "classes")
    out = classed.join(least, "_class", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("_links").alias("n_links"))


def keep_one_of_each(docs: DataFrame, width: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each class the least doc_id stays (no id comes last).

    Documents without words are no copies of anything and stay.  Of rows that repeat
    in id and text one stays.
    """
    scratch, key = Scratch(docs.sparkSession, "near"), ["_k", "_j"]
    rows = keyed(wrapped(docs, "doc_id", "text"))
    classed = classify_keys(rows.select(F.col("_k").alias("k"), F.col("_j").alias("j"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id")), scratch, width, t)
    rows = rows.select("row", *key)
    rank = F.struct(F.col("id").isNull(), "id", "k", "j")
    first = scratch.table(classed.where("_class is not null").groupBy("_class").agg(F.min(rank).alias("first")), "first")
    named = lambda d: d.select(F.col("k").alias("_k"), F.col("j").alias("_j"))
    lost = named(classed.where("_class is not null").join(first, "_class").where((F.col("k") != F.col("first.k")) | (F.col("j") != F.col("first.j"))))
    again = scratch.table(named(classed.where("copies > 1")), "again")
    lost = scratch.table(lost, "lost")
    gone = scratch.table(lost.union(again).distinct(), "gone")
    once = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")  # texts stay where they are
    if not again.isEmpty():
        once = once.union(rows.join(again.join(lost, key, "left_anti"), key, "left_semi").dropDuplicates(key).select(*once.columns))
    return unwrapped(once)
