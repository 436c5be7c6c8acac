"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, root): each node of an edge with the smallest node it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    its smallest neighbour, until the edges are stars; the number of rounds grows
    with the logarithm of the nodes. Minima are aggregated before they shuffle,
    and those of hubs are broadcast to their edges, so that no task gets all edges
    of a hub. Each round is written to the shared folder, and the last one removed.
    """
    edges = common.staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = common.spread_join(both, least, ["u"], 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.spread_join(large, least, ["u"], before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        last, edges = edges, common.staged(small, "small-star")
        common.discard(last)
        common.discard(large)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
