"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and joins over the edges, and ends when the edges no longer change; the rounds needed grow
with the logarithm of the graph. Nodes never meet in one task: a node with most of the edges is a large key of a join
against one row per node, which the planner splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


def _star(pairs: DataFrame, label: str) -> DataFrame:
    """(u, v) -> (u, v, m): m the least of u and its partners v."""
    pairs = stored(pairs, f"{label}-pairs")
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), f"{label}-least")
    return pairs.join(least, pairs["u"] == least["_u"]).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with long ids -> (node, root) for every node that has an edge; root is the least node reachable."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large, "small")
        down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.select("u", F.col("m").alias("v")).where("u <> v")
        edges = stored(down.unionByName(own).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
