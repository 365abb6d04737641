"""Connected components of an edge table by alternating stars, with joins and sums only.

Each round points the larger neighbours of every node at the smallest one known (large star), then does the same for
the smaller neighbours (small star), until nothing changes; a graph of any shape ends as stars around the smallest node
of each component. Rounds are written to the shared scratch folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, component) for every node with an edge to another; the component is its smallest node.

    Null ends and loops are left out; repeated edges count once; without edges the result is empty.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") > F.col("v")))
    e = common.materialise(e.distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, common.materialise(moved.union(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        common.forget(last)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
