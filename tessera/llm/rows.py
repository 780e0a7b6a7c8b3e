"""Rows that pass through a stage whole, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(docs: DataFrame, *needed: str, **computed: Column) -> DataFrame:
    """``row``, a struct of all columns, beside the columns that an operator needs."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(every, *needed, *[c.alias(n) for n, c in computed.items()])


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
