"""Connected components of a distributed graph by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest neighbour (large star),
then its smaller ones (small star), until only stars are left: O(log^2 n) rounds, about
five on near-duplicate graphs. Edges stay distributed and are written to the shared
folder between rounds, so a lost executor costs one round at most. The joins are plain
equi-joins on a node, which adaptive execution splits where a hub has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node in edges(a, b) of long ids.

    Loops, repeated and reversed edges are allowed; nodes without edges do not appear;
    rows with a null end are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = materialise(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        small = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == last:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
