"""Sharding by global byte-size prefix sums (operator 4, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ordering import ranged, with_prefix
from tessera.llm.scratch import Scratch, partitions


def shard_by_bytes(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Cut ``rows`` in global order into ``n_shards`` contiguous shards of near-equal bytes.

    ``rows`` holds the ``order`` columns, a positive ``size`` and whatever else is to
    be kept; adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).
    A row belongs to the shard in whose equal share of all bytes its middle byte
    falls, so a shard is off its target by less than one row at either end.

    Null order values come first.  Rows equal in all order columns are
    interchangeable.  An empty table gives an empty result.  With fewer rows than
    shards some shards stay empty.
    """
    spark = rows.sparkSession
    scratch, n = Scratch(spark, "shard"), partitions(spark)
    sorted_rows = ranged(rows.withColumn("_one", F.lit(1).cast("long")), order, scratch, "ranges", n)
    total = sorted_rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    at = with_prefix(sorted_rows, order, {"_bytes": size, "_row": "_one"}, n)
    middle = F.col("_bytes").cast("decimal(38,0)") * 2 + F.col(size)
    shard = F.least(F.floor(middle * n_shards / (F.col("_total").cast("decimal(38,0)") * 2)), F.lit(n_shards - 1)).cast("int")
    placed = scratch.table(at.join(F.broadcast(total)).withColumn("shard", shard).drop("_total", "_bytes", "_one"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Shards of ``documents`` by the law ``bytes``: UTF-8 bytes of the text plus ``overhead``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this
    law).  A null text counts as no bytes and has the checksum of the empty string;
    repeated rows each get a slot of their own; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(rows, n_shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
