"""Connected components of a graph of BIGINT nodes by alternating stars, in a number of rounds that grows as log(n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v), u > v: hang the larger (or smaller) neighbours of each node on its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of its component for each node that has an edge to another and isn't itself the root.

    edges: (u, v) BIGINT in any order; nulls and loops are ignored, repeated edges count once. Only aggregated
    minima are joined back, so a node with very many edges costs a skewed join at most, which AQE splits. The
    state of each round is a checkpoint.
    """
    u, v = F.col("u"), F.col("v")
    now = checkpoint(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(most_rounds):
        now = checkpoint(_star(_star(now, large=True), large=False))
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
