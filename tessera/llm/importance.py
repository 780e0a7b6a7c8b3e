"""Quality classifier by importance resampling (operator 8).

Two generative models over hashed n-grams, one of the target (labelled documents
of good quality and without toxicity) and one of the raw text (every document),
give each document the log ratio of its probabilities under both.  Documents are
sampled by Gumbel top-k: the k documents with the greatest log weight plus Gumbel
noise, which is drawn from a hash of the document, stay.

The ratio of a whole document grows with its length, and next to hundreds of nats
noise decides nothing.  So the weight is that of a stretch of ``STRETCH`` features
of the document: its mean log ratio times ``STRETCH``.  Documents whose weights
differ by a unit or two are sampled, those far apart are not.

k is the size of the target in the raw text: the sum, over all documents, of the
probability of being good given the weight, by a logistic model of one variable
that is fitted on the labelled documents (with its intercept free, it expects as
many good ones among them as there are).  Toxic documents of good quality are left
out of the target, but are not poor either: they do not fit the model, and stay where
their weight lets them.

Tokens are runs of letters, digits or other signs.  There are three families of
features: tokens, pairs of tokens, and triples of token shapes (kind, case, and
whether the token repeats one of the two before it); each has ``2**BITS``
buckets, so the models have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytehash import hashes, mix
from tessera.llm.ngram_join import keyed
from tessera.llm.ordering import ranged, with_prefix
from tessera.llm.rows import unwrapped, wrapped
from tessera.llm.scratch import Scratch, partitions
from tessera.llm.shingles import raw, slices

BITS = 16
FAMILIES = 3
MOST_LABELS = 20_000  # labelled rows that are used, a bound on the sample the classifier is fitted on
SMOOTHING = 64.0
STRETCH = 16  # features that a document's weight stands for: the temperature of the sampling

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def _behind(x: np.ndarray, by: int, same: np.ndarray, other: int) -> np.ndarray:
    """Values ``by`` tokens before, in the same text; ``other`` where there is none."""
    out = np.full(len(x), other, np.uint64)
    if len(x) > by:
        out[by:] = np.where(same, x[:-by], np.uint64(other))
    return out


def features(texts: list[np.ndarray], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the number of the text that each is of."""
    data = np.full(sum(len(t) + 1 for t in texts), 0x20, np.uint8)
    at, ends = 0, np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        data[at : at + len(t)] = t
        at += len(t) + 1
        ends[i] = at
    kind = _KIND[data]
    edge = np.r_[True, kind[1:] != kind[:-1]]
    start, stop = np.flatnonzero(edge & (kind > 0)), np.flatnonzero(np.r_[edge[1:], True] & (kind > 0)) + 1
    h = hashes(data, start, stop)
    owner = np.searchsorted(ends, start, "right")
    near = [owner[by:] == owner[:-by] if len(owner) > by else np.zeros(0, bool) for by in (1, 2)]
    before = [_behind(h, by, near[by - 1], by) for by in (1, 2)]
    shape = kind[start].astype(np.uint64) << np.uint64(4)
    for bit, flag in enumerate((h == before[0], h == before[1], _UPPER[data[start]], _UPPER[data[start + 1]])):
        shape |= flag.astype(np.uint64) << np.uint64(bit)
    shapes = shape
    for by in (1, 2):
        shapes = (shapes << np.uint64(10)) | _behind(shape, by, near[by - 1], 1023)
    mixed = (mix(h + np.uint64(11)), mix(mix(h) + before[0]), mix(shapes + np.uint64(13)))
    return np.concatenate([(x >> np.uint64(64 - bits)).astype(np.int64) + (f << bits) for f, x in enumerate(mixed)]), np.tile(owner, FAMILIES)


def _counted(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FAMILIES << bits
        every, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            wanted, at = np.array(batch.column("target").to_pylist(), bool), 0
            for texts in slices(raw(batch.column("text"))):
                bucket, owner = features(texts, bits)
                every += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[wanted[at : at + len(texts)][owner]], minlength=size)
                at += len(texts)
        some = np.flatnonzero(every)
        yield pa.record_batch([pa.array(some), pa.array(every[some]), pa.array(target[some])], names=["bucket", "every", "target"])

    return rows


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability for each bucket, both smoothed towards the raw model."""
    out, size = np.zeros(len(every)), len(every) // FAMILIES
    for f in range(FAMILIES):
        at = slice(f * size, (f + 1) * size)
        expected = every[at] * (target[at].sum() / max(1, every[at].sum()))
        out[at] = np.log((target[at] + SMOOTHING) / (expected + SMOOTHING))
    return out


def _scored(ratios: np.ndarray, bits: int, stretch: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [np.zeros(0)]
            for texts in slices(raw(batch.column("_text"))):
                bucket, owner = features(texts, bits)
                total, n = np.bincount(owner, weights=ratios[bucket], minlength=len(texts)), np.bincount(owner, minlength=len(texts))
                weights.append(total * (stretch / np.maximum(n, stretch)))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(weights))], names=[*[n for n in batch.schema.names if n != "_text"], "_weight"])

    return rows


def sample_labels(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """One label (good: quality 1 and not toxic, poor: quality 0) for each of at most ``most`` doc_ids, those of the least hashes."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("_good"), (F.col("q") == 0).alias("_poor"))


def logistic(weight: np.ndarray, good: np.ndarray, rows: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> tuple[float, float]:
    """(intercept, slope) of the log odds of being good, by Newton's method; the slope has a small ridge, as the sides may be apart."""
    scale = max(1e-9, float(np.abs(weight).max()))
    x = np.c_[np.ones(len(weight)), weight / scale]
    beta, loss = np.zeros(2), math.inf
    penalty = np.array([0.0, ridge])
    for _ in range(rounds):
        z = x @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = x.T @ (rows * (p - good)) + penalty * beta
        hessian = (x * (rows * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        value = lambda b: float(rows @ (np.logaddexp(0, x @ b) - good * (x @ b)) + (penalty * b * b).sum() / 2)
        loss = value(beta)
        while size > 1e-6 and value(beta - size * step) > loss:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9 * (1 + np.abs(beta).max()):
            break
    return float(beta[0]), float(beta[1] / scale)


def gumbel(seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_k"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


class Classifier:
    """Fitted on all of ``docs`` and a bounded sample of ``labels``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 5, bits: int = BITS, stretch: int = STRETCH):
        spark = docs.sparkSession
        self.scratch, self.noise, self.bits, self.stretch = Scratch(spark, "importance"), gumbel(seed), bits, stretch
        sample = self.scratch.table(sample_labels(labels), "labels")
        text = F.coalesce("text", F.lit("")).alias("text")
        marked = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id", "left")  # at most MOST_LABELS rows
        counts = marked.select("text", F.coalesce("_good", F.lit(False)).alias("target")).mapInArrow(_counted(bits), "bucket long, every long, target long")
        found = counts.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toArrow()  # at most FAMILIES * 2**bits rows
        every, target = np.zeros(FAMILIES << bits), np.zeros(FAMILIES << bits)
        every[found["bucket"].to_numpy()], target[found["bucket"].to_numpy()] = found["every"].to_numpy(), found["target"].to_numpy()
        self.ratios = log_ratios(every, target)
        self.scores = self.scratch.table(self.weigh(docs.select("doc_id", "text")), "scores")
        # a row for each labelled doc_id, however often it occurs: at most MOST_LABELS
        seen = self.scores.join(F.broadcast(sample), "doc_id").where("_good or _poor").groupBy("doc_id", "_good").agg(F.avg("_weight").alias("w"), F.count("*").alias("n")).orderBy("doc_id").collect()
        self.k = self._target_size([(r.w, r._good, r.n) for r in seen])
        self.cutoff = self._cutoff()

    def _target_size(self, seen: list[tuple[float, bool, int]]) -> int:
        if len({good for _, good, _ in seen}) < 2:
            return self.scores.count()
        w, good, n = (np.array(x, float) for x in zip(*seen, strict=True))
        intercept, slope = logistic(w, good, n)
        odds = F.lit(intercept) + F.lit(slope) * F.col("_weight")
        return round(self.scores.agg(F.coalesce(F.sum(1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))), F.lit(0.0))).first()[0])

    def weigh(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, text and perhaps a row) without the text, with _k, _weight and _key."""
        rows = keyed(rows).withColumn("_text", F.coalesce("text", F.lit(""))).drop("text")
        schema = T.StructType([*[f for f in rows.schema if f.name != "_text"], T.StructField("_weight", T.DoubleType())])
        return rows.mapInArrow(_scored(self.ratios, self.bits, self.stretch), schema).withColumn("_key", F.col("_weight") + self.noise)

    def _cutoff(self) -> float:
        """The k-th greatest key, below which none is selected; ties at it all are.  Keys are sorted into ranges, and the ranks come from the ranges' counts."""
        if self.k == 0:
            return math.inf
        n = partitions(self.scratch.spark)
        order = [F.col("_key").desc(), F.col("_k")]
        rows = ranged(self.scores.select("_key", "_k", F.lit(1).cast("long").alias("_one")), order, self.scratch, "keys", n)
        at = with_prefix(rows, order, {"_rank": "_one"}, n).where(F.col("_rank") == self.k - 1).first()
        return at._key


def sample_documents(docs: DataFrame, labels: DataFrame, seed: int = 5, bits: int = BITS, stretch: int = STRETCH) -> DataFrame:
    """One row a document: doc_id, log_weight, sample_key, selected.

    k is the number of documents that the labelled ones let expect to be good; without
    labels of both sides all documents are selected.  Rows that are equal in id and
    text have equal keys and share their fate, so more than k are selected where the
    k-th key is theirs.  A null or empty text has the weight 0.  An empty table gives
    an empty result.
    """
    fitted = Classifier(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, seed, bits, stretch)
    return fitted.scores.select("doc_id", F.col("_weight").alias("log_weight"), F.col("_key").alias("sample_key"), (F.col("_key") >= F.lit(fitted.cutoff)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are selected, with the columns of ``docs``."""
    fitted = Classifier(docs.select("doc_id", "text"), labels)
    return unwrapped(fitted.weigh(wrapped(docs, "doc_id", "text")).where(F.col("_key") >= F.lit(fitted.cutoff)))
