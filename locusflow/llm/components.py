"""Connected components by alternating large-star and small-star rounds, with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import join_by_size, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node of the component.

    Every round keeps one edge per node and neighbour label, so the rows never outnumber the edges given. Minima
    are aggregated before they are shuffled; those of hubs, nodes with more than a thousandth of all edges, are broadcast, so
    that a hub's edges stay spread over the tasks that hold them. Edges with a null end or equal ends link nothing; nodes
    that occur only in such edges are not returned.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    e = materialize(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(hi, lo).distinct(), "edges"
    )
    seen = _state(e)
    for _ in range(max_rounds):
        up, down = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")), e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        # each node's smallest neighbour or itself, and how many larger ones there are to be moved to it
        least = up.select("u", "v", F.lit(1).alias("k")).union(down.select("u", "v", F.lit(0).alias("k")))
        least = least.groupBy("u").agg(F.min("v").alias("m"), F.sum("k").alias("n")).filter("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        moved = join_by_size(up, least, "u", "n", seen[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(moved.distinct(), "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        rest = join_by_size(large, low.filter("n > 1"), "hi", "n", seen[0]).filter(F.col("lo") != F.col("m"))
        e = materialize(rest.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.union(members.select(F.col("root").alias("node"), "root").distinct())


def _state(e: DataFrame) -> tuple:
    """Enough of an edge set to see whether a round changed it: a star forest maps onto itself. The first is its size."""
    row = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo").cast("decimal(38,0)"))).first()
    return tuple(row)
