"""Connected components of a graph of pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_table, written


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its lesser neighbours, and itself, to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    up = edges.join(least, "b")
    out = up.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(up.select(F.col("m").alias("a"), "b"))
    return out.filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """id, component (the least id that it is linked to, over any number of pairs (a, b)); only ids that are in a pair.

    The number of rounds grows with the logarithm of the size of a component; each round is written to the shared folder."""
    edges = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        # stars have settled when every node has one edge, to a node that is no one's greater end
        now = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        old, edges = edges, written(small_star(large_star(edges)), "stars")
        drop_table(old)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
