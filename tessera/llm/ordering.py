"""Global order and prefix sums without a single-task window.

Rows are range-partitioned and written with the number of their range; the
totals of the ranges (one row a range) are summed up in order and broadcast, and
a window inside each range adds the rest.

Where whole rows must lie in contiguous ranges that follow from the data alone,
``cuts`` finds the first key of each range from keys and sizes, and ``number`` looks
a row's range up.  There are at most ``MOST_RANGES`` cuts, which is what the plan of
a query holds; ranges of more rows are sorted by spilling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, partitions


MOST_RANGES = 1 << 16


def ranged(df: DataFrame, order: list, scratch: Scratch, name: str, n: int | None = None) -> DataFrame:
    """``df`` sorted into ranges of ``order`` and written, with the range's number as ``_part``."""
    n = n or partitions(scratch.spark)
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return scratch.table(parts.withColumn("_part", F.spark_partition_id()), name)


def with_prefix(df: DataFrame, order: list, measures: dict[str, str], n: int) -> DataFrame:
    """Add, for each ``out: column`` of ``measures``, the sum of ``column`` over all rows before.

    ``df`` comes from :func:`ranged`.  Only the totals of the ranges are broadcast:
    one row for each of the ``n`` ranges, whatever the number of rows.
    """
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in measures.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in measures])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.repartitionByRange(n, "_part")
    rows = reduce(lambda d, m: d.withColumn(f"_w_{m[0]}", F.coalesce(F.sum(m[1]).over(inside), F.lit(0))), measures.items(), rows)
    rows = rows.join(F.broadcast(bases), "_part")
    rows = reduce(lambda d, o: d.withColumn(o, F.col(f"_w_{o}") + F.col(f"_b_{o}")), measures, rows)
    return rows.drop("_part", *[f"_{x}_{o}" for o in measures for x in "wb"])


def cuts(light: DataFrame, keys: list[str], size: str, least: int, scratch: Scratch) -> list[Row]:
    """The first keys, in order, of ranges of equal sums of ``size``, ``least`` or more each; the first is that of the first row.

    ``light`` holds the ``keys``, which sort ascending with nulls first, and ``size``.
    Rows of one key are in one range.
    """
    light, n = light.select(*keys, F.col(size).alias("_size")), partitions(scratch.spark)
    total = light.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    step, order = max(1, least, -(-total // MOST_RANGES)), [F.col(k) for k in keys]
    at = with_prefix(ranged(light, order, scratch, "sizes", n), order, {"_before": "_size"}, n)
    firsts = at.groupBy(F.floor(F.col("_before") / step).alias("range")).agg(F.min(F.struct(*keys)).alias("first"))
    found = [r.first for r in firsts.orderBy("range").collect()]  # at most MOST_RANGES rows
    # a key with more rows than a range holds opens several; it gets one
    return [x for i, x in enumerate(found) if not i or x != found[i - 1]]


def _literal(light: DataFrame, keys: list[str], cut: Row) -> Column:
    return F.struct(*[F.lit(cut[k]).cast(light.schema[k].dataType).alias(k) for k in keys])


def number(light: DataFrame, keys: list[str], found: list[Row]) -> Column:
    """The number, from 0, of a row's range among ``found``: blocks of cuts first, then inside a block."""
    later = [_literal(light, keys, x) for x in found[1:]]
    if not later:
        return F.lit(0)
    step, here = max(1, int(len(later) ** 0.5)), F.struct(*keys)
    block = F.size(F.filter(F.array(*later[step - 1 :: step]), lambda x: x <= here)) * step
    return block + F.size(F.filter(F.slice(F.array(*later), block + 1, step), lambda x: x <= here))


def opens(light: DataFrame, keys: list[str], found: list[Row], at: Column) -> Column:
    """Whether a row of range ``at`` has the key that opens it."""
    return F.get(F.array(*[_literal(light, keys, x) for x in found]), at) == F.struct(*keys)
