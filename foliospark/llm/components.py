"""Connected components of a distributed graph by alternating large-star and small-star steps.

Each round rewrites the edges so that nodes point to smaller nodes; the graph ends as stars whose
centres are the smallest members. A round's edges are written to the shared folder, so the plan
does not grow. The minimum of a node's neighbours is a partial aggregate, and the join that follows
is one that Spark can split, so a node with very many edges is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a centre and no centre has any."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out")).distinct())
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n")).filter("out > 1 or (out = 1 and n > 1)")
    return odd.limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Loops and repeated edges are harmless. Raises if the graph has not settled after ``rounds``; the
    number needed grows with the logarithm of the largest component.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _is_stars(current):
            leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            centres = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return leaves.unionByName(centres)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        release(current, large)
        current = small
    raise RuntimeError("the components did not settle")
