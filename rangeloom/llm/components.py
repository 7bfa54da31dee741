"""Connected components by alternating large-star and small-star rounds.

Every round is two joins of the edge table with its own per-node minima.  Minima are
aggregated before they are shuffled, the joins are plain equi-joins whose hot keys the
adaptive planner may split, and the state between rounds lies in the shared checkpoint
folder.  Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """(centre, m): the least of each u and its neighbours v."""
    return edges.groupBy(F.col("u").alias("centre")).agg(F.least(F.min("v"), F.min("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node's neighbours and itself.

    Takes and returns (u, v) edges with v < u; repeats are left to the small star.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("centre"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them; distinct (u, v) with v < u from edges of that kind."""
    least = _least(edges)
    joined = edges.join(least, F.col("u") == F.col("centre"))
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("centre").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node.

    Loops and repeated edges do no harm; no edges give an empty frame.
    """
    kind = edges.schema["u"].dataType
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = cut(edges)
    mark = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return edges.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
