"""Bit-planes: blocks of 64 rows of a field as 64 words, word b holding bit b of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import unsigned as U

ROWS = 64


def _bit(v: Column, b: int) -> Column:
    return F.shiftrightunsigned(v, b).bitwiseAND(1)


def slice_planes(rows: DataFrame, position: str, field: str, planes: int = 64) -> DataFrame:
    """(block_id, planes, n_rows): an array of 64 words for each block; words from ``planes`` on are 0.

    ``position`` numbers the rows from 0.  Each word is a grouped ``bit_or``, so rows
    are combined before the shuffle and no row is multiplied by its bits.
    """
    row = F.pmod(F.col(position), F.lit(ROWS)).cast("int")
    at = rows.select(F.floor(F.col(position) / ROWS).cast("bigint").alias("block_id"), F.call_function("shiftleft", U.lit(1), row).alias("_mask"), F.col(field).cast("bigint").alias("_v"))
    words = [F.bit_or(F.when(_bit(F.col("_v"), b) == 1, F.col("_mask")).otherwise(U.lit(0))).alias(f"_w{b}") for b in range(planes)]
    grouped = at.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"), *words)
    return grouped.select("block_id", F.array(*[F.col(f"_w{b}") if b < planes else U.lit(0) for b in range(64)]).alias("planes"), "n_rows")


def slice_fields(rows: DataFrame, position: str, fields: list[str], planes: int = 64) -> DataFrame:
    """(block_id, n_rows, an array of 64 words for each of ``fields``), in one grouping."""
    row = F.pmod(F.col(position), F.lit(ROWS)).cast("int")
    at = rows.select(F.floor(F.col(position) / ROWS).cast("bigint").alias("block_id"), F.call_function("shiftleft", U.lit(1), row).alias("_mask"), *[F.col(f).cast("bigint").alias(f"_v{i}") for i, f in enumerate(fields)])
    words = [F.bit_or(F.when(_bit(F.col(f"_v{i}"), b) == 1, F.col("_mask")).otherwise(U.lit(0))).alias(f"_w{i}_{b}") for i in range(len(fields)) for b in range(planes)]
    grouped = at.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"), *words)
    return grouped.select("block_id", "n_rows", *[F.array(*[F.col(f"_w{i}_{b}") if b < planes else U.lit(0) for b in range(64)]).alias(f) for i, f in enumerate(fields)])


def as_rows(planes: DataFrame) -> DataFrame:
    """(block_id, bit, plane), a row for each word."""
    return planes.select("block_id", F.posexplode("planes").alias("bit", "plane"))


def unslice(planes: DataFrame) -> DataFrame:
    """(position, value): the inverse."""
    at = planes.select("block_id", "planes", F.explode(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1)).alias("_r"))
    value = F.aggregate(
        F.transform("planes", lambda w, b: F.call_function("shiftleft", F.call_function("shiftrightunsigned", w, F.col("_r")).bitwiseAND(1), b)), U.lit(0), lambda a, x: a.bitwiseOR(x)
    )
    return at.select((F.col("block_id") * ROWS + F.col("_r")).alias("position"), value.alias("value"))


def _mask_greater(planes: Column, threshold: int) -> Column:
    """The word of rows whose value is greater, from the top bit down."""
    bits = F.array(*[U.lit(-1 if threshold % U.WORD >> b & 1 else 0) for b in range(64)])
    start = F.struct(U.lit(0).alias("above"), U.lit(-1).alias("equal"))

    def step(acc: Column, i: Column) -> Column:
        w, c = F.get(planes, i), F.get(bits, i)
        above = acc["above"].bitwiseOR(acc["equal"].bitwiseAND(w).bitwiseAND(F.bitwise_not(c)))
        return F.struct(above.alias("above"), acc["equal"].bitwiseAND(F.bitwise_not(w.bitwiseXOR(c))).alias("equal"))

    return F.aggregate(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["above"])


def native_mask(planes: DataFrame, threshold: int) -> DataFrame:
    """(block_id, mask): rows above the threshold, found on the planes; rows that a short block lacks are 0."""
    lacking = F.col("n_rows") >= ROWS
    real = F.when(lacking, U.lit(-1)).otherwise(F.call_function("shiftleft", U.lit(1), F.col("n_rows").cast("int")) - 1)
    return planes.select("block_id", _mask_greater(F.col("planes"), threshold).bitwiseAND(real).alias("mask"))


def native_count(planes: DataFrame, threshold: int) -> DataFrame:
    """One row: how many rows are above the threshold."""
    return native_mask(planes, threshold).agg(F.coalesce(F.sum(F.bit_count("mask").cast("bigint")), F.lit(0)).alias("result"))
