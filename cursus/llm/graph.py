"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being its component's smallest node.

    Each round ties all smaller neighbours of a node to the smallest one; minima combine before the shuffle, and the edges
    of a node with very many neighbours stay where they are. When each node has one smaller neighbour, pointers are halved.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.count(F.lit(1)).alias("n"))
        least = written(least, "least")
        if least.where("m <> most").isEmpty():
            break
        tied = hot_join(edges, least.select("a", "m"), "a", "inner", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    up = least.select(F.col("a").alias("node"), F.col("m").alias("root"))
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        if above.join(up.select(F.col("root").alias("root")).distinct(), "root", "left_semi").isEmpty():
            break
        up = written(hot_join(up, above, "root").select("node", F.coalesce("higher", "root").alias("root")), "up")
    roots = up.select(F.col("root").alias("node"), "root").distinct()
    return up.unionByName(roots)
