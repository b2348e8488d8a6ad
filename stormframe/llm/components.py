"""Connected components of an edge table, in rounds of joins; nothing gathers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import checkpointed

#: Edges of one task, about; more of them are dealt out over as many tasks as there are.
EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node with an edge in ``a, b``.

    Alternates large-star and small-star steps: each node's larger, then its
    smaller, neighbours are linked to the least one, until the edges are stars
    (in a number of rounds that grows with the logarithm of the longest path).
    Minima are combined before they are shuffled, and a join deals a node's
    neighbours out, so a node with very many of them can be split.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:
        # Few edges in few tasks: each of a round's shuffles costs a file for each of its tasks.
        few = mark[0] // EDGES + 1
        now = now.coalesce(few)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(2 * few)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = checkpointed(small.filter("u <> v").distinct().coalesce(2 * few))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge tables apart by their size and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
