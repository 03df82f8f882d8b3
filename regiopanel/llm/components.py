"""Connected components of a large graph by alternating star contractions.

Each round every node points its larger neighbours at its smallest neighbour (large star), then
its smaller neighbours and itself at the smallest (small star). The smallest neighbour comes from
an aggregate that combines in each task, and goes back to the edges by a join on the node, which
adaptive execution splits where a node has very many edges. Rounds are written to the shared
folder, so no round depends on lost executors and the plan stays short; only the number of nodes that aren't
settled comes to the driver. The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.session import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every node either points at one smaller node, or is pointed at: then that node is its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the edges ``a, b``; the smallest itself included.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows. An error is
    raised, never a wrong label given, if ``rounds`` don't suffice.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # few smaller neighbours are left to any node
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
