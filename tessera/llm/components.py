"""Connected components of a graph of links, by large-star and small-star steps.

Each step is a grouped minimum and a join on the node; both sides of the join are
written first, so a node with very many links is split by skew handling.  The
steps end when the edges are stars: no node has two edges upwards, and none that
another is tied to has one.  Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Tie the greater (large) or not greater (small) neighbours of each node to its least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
    tied = both.join(least, "u")
    tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return scratch.table(tied.where("a != b").distinct(), name)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its least node."""
    edges = scratch.table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}-0")
    round_ = 0
    while True:
        n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        round_ += 1
        wide = _star(edges, scratch, f"{name}-{round_}-large", True)
        new = _star(wide, scratch, f"{name}-{round_}", False)
        scratch.drop(f"{name}-{round_ - 1}", f"{name}-{round_}-large", f"{name}-{round_}-large-least", f"{name}-{round_}-least")
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
