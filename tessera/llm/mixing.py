"""Mixing sources to target weights (operator 5).

Words are aggregated for each source, targets are the weighted shares with the
excess over twice a source's size dealt out again, and a document is emitted
``floor(rate)`` times plus once more with the probability of the fraction, drawn
from a hash of the seed and the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import unwrapped, wrapped
from tessera.llm.scratch import Scratch

#: fixed value: a word is a run of other characters than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``target``.

    The level L solves sum(min(w * L, most * size)) = share * sum(size): sources are
    ordered by the level at which they reach their cap, and prefix sums of the caps
    and suffix sums of the weights give the level at each.  The table has one row
    for each source, which is all that the ordered windows see.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    order = [F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = caps.withColumn("_level", level)
    # levels rise up to the right one, the first that its source can take, and fall after it
    final = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    target = F.least(F.col("_w") * F.coalesce(final, F.lit(float("inf"))), F.col("_cap"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source and a row) with _size, _source_size, _target and _copies (long).

    ``_copies`` is how often the mix takes the document.  A null text has no words, a
    null source is a source of its own (the last).  A source without words gets the
    target 0 and none of its documents are taken.  Repeated rows of one doc_id draw
    alike; documents without a doc_id draw by their text.
    """
    sized = docs.withColumn("_size", word_count(F.col("text")))
    totals = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    # written, so that Spark knows its size: small tables are broadcast, others are shuffled
    targets = Scratch(docs.sparkSession, "mix").table(source_targets(totals, weights, share, most), "targets").select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_copies", copies.cast("long"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken."""
    mixed = mix(wrapped(docs, "doc_id", "text", "source")).where("_copies > 0")
    return unwrapped(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words the mix takes)."""
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
