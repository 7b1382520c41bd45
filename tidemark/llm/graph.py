"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


def _smallest(edges: DataFrame) -> DataFrame:
    """For each u the least of its neighbours and itself; summed map-side, so that a node with many edges is no burden."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) in both directions (large) or from the greater to the lesser end (small): neighbours are linked to the least one."""
    joined = edges.join(_smallest(edges), "u")
    if large:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return linked.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node that can be reached.

    Alternates large-star and small-star steps until the edges stay the same. Each step is an aggregate with map-side
    sums and a join that adaptive execution may split, and every round ends in a table in the shared folder. Self-loops give (node, node).
    Nodes are long integers; null ends are not allowed. An empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    now = checkpointed(pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = checkpointed(_star(_star(both, large=True), large=False))
        after = mark(now)
        if after == before:
            break
        before = after
    return nodes.distinct().join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
