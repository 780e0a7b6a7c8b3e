"""Bottom-k sketches of shingle hashes (operator 9, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.mixing import WORD
from tessera.llm.ordering import cuts, number, opens
from tessera.llm.scratch import Scratch, partitions

PREFIX = 32  # code points of a text that tell rows of one doc_id apart when ranges are cut


def with_sketch(df: DataFrame, text: str, out: str, k: int = 128, width: int = 5) -> DataFrame:
    """Add ``out``: the ``k`` smallest distinct hashes of the ``width``-word shingles of ``text``.

    A text with fewer words is one shingle; a text without words has an empty sketch.
    The hashes of the words are a column of their own: the shingles look them up, and
    must not compute them again for each shingle.
    """
    h = f"_{out}_words"
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size(h)
    many = F.transform(F.slice(h, 1, F.greatest(n - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, width)]))
    shingles = F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(h)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    low = merge(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(low, a), b)), F.size(low)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike (1), an empty and another are not (0)."""
    both, low = _common(a, b, k)
    return F.when(low == 0, F.lit(1.0)).otherwise(both / low)


def distinct_shingles(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) over the k-th smallest hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _bucketed(docs: DataFrame) -> DataFrame:
    """Deal ``docs`` into ranges of descending doc_id and ascending text; the rows that open the next range come along as its tail.

    Ranges are cut at equal sums of bytes, by doc_id and the begin of the text, so
    neither many rows of one id nor many without one are in one range.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    id_, keys = F.col("doc_id").cast("long"), ["_none", "_down", "_begin"]
    docs = docs.withColumns({"_none": id_.isNull(), "_down": F.coalesce(F.bitwise_not(id_), F.lit(0)), "_begin": F.substring("text", 1, PREFIX)})
    sized = docs.select(*keys, (F.octet_length("text") + 64).cast("long").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = cuts(sized, keys, "size", total // (4 * partitions(docs.sparkSession)), scratch)
    if not found:
        return docs.withColumn("_at", F.struct(F.lit(0).alias("b"), F.lit(0).alias("tail"))).drop(*keys)
    docs = docs.withColumn("_b", number(sized, keys, found))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("tail"))
    tail = F.struct(((F.col("_b") + (len(found) - 1)) % len(found)).alias("b"), F.lit(1).alias("tail"))
    return docs.withColumn("_at", F.explode(F.when(opens(sized, keys, found, F.col("_b")), F.array(own, tail)).otherwise(F.array(own)))).drop("_b", *keys)


def fingerprint_documents(docs: DataFrame, k: int = 128, width: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text is the text with its last floor(n_chars / 2) code points replaced
    by the first as many of the next document's, in descending doc_id order, the
    first document following the last.  A null text is empty.  Rows of one doc_id
    follow each other in the order of their texts; rows without an id come last.  A
    single document follows itself.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = _bucketed(rows).select("doc_id", "text", F.col("_at.b").alias("_b"), F.col("_at.tail").alias("_tail")).repartition("_b")
    sketched = with_sketch(dealt, "text", "_sketch", k, width).withColumn("n_chars", F.length("text").cast("long"))
    order = Window.partitionBy("_b").orderBy("_tail", F.col("doc_id").desc_nulls_last(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # the tail is of no more use than its first row; a row that has none after it is alone
    after = sketched.withColumn("_next", F.coalesce(F.lead("text").over(order), F.col("text"))).withColumn("_next_sketch", F.coalesce(F.lead("_sketch").over(order), F.col("_sketch"))).where("_tail = 0")
    edited = after.withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half))).drop("text", "_next")
    edited = with_sketch(edited, "_edited", "_edited_sketch", k, width)
    a, b, c = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).cast("double").alias("near_edited"),
        resemblance(a, c, k).cast("double").alias("near_next"),
        distinct_shingles(a, k).alias("n_shingles_estimate"),
    )
