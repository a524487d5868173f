"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)`` but the roots; a root is the least node of its component.

    Alternating stars (Kiveris et al., 2014): each round links a node's larger
    neighbours to its least one, then its smaller ones.  Least neighbours come
    from partial sums and a join, so a hub's rows never meet in one task.  Each
    round is written to the shared folder.
    """
    table = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(table)
    while state[0]:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(table)
        table, before = after, state
        state = _state(table)
        if state == before:
            break
    return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
