"""Connected components by contraction, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, jumps pointers twice and contracts, so that a chain
    shrinks at least fourfold. A hub's edges are counted map-side; each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    mapping = None
    while True:
        near = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        for _ in range(2):
            above = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
            near = near.join(above, "p").select("a", F.col("q").alias("p"))
        near = written(near)
        if mapping is None:
            mapping = near.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            mapping = written(mapping.join(near.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left = both.join(near, "a").select("b", F.col("p").alias("pa"))
        both = written(left.join(near.withColumnRenamed("a", "b"), "b").where("pa <> p").select(F.col("pa").alias("a"), F.col("p").alias("b")).distinct())
        if both.isEmpty():
            return mapping
