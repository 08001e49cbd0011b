"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import Folder


def components(edges: DataFrame, folder: Folder) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is its smallest node.

    Large-star hangs every larger neighbour of a node on the smallest node around it,
    small-star does so for the smaller ones; alternating, they end in stars after a number
    of rounds that grows with the logarithm of the longest chain. Neighbourhoods are only
    ever reduced to their minimum, and a hub's rows meet it in a join that can be split.
    """
    now = folder.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars0")
    seen = None
    for turn in range(1, 1 << 20):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = folder.write(large.where("a <> b").distinct(), f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        now = folder.write(small.where("a <> b").distinct(), f"stars{turn}")
        folder.drop(f"large{turn}")
        folder.drop(f"stars{turn - 1}")
        state = now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(20,0)))")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
