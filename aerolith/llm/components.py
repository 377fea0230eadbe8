"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import materialize, remove


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges``; component is the smallest node reached.

    Large-star links every larger neighbour of a node to the smallest of its neighbourhood,
    small-star does so for the smaller ones; both keep connectivity, and after O(log^2 n) rounds
    only stars are left.  Each round is written to the shared folder.  Self loops and nulls are
    ignored (a node with no other link is not returned); repeated edges count once.  An empty
    table gives an empty result.  The minimum of a neighbourhood is combined before the shuffle and
    joined back, so a node with millions of neighbours is spread over tasks.
    """
    x, y = F.col(a), F.col(b)
    star = materialize(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    before = _signature(star)
    for _ in range(max_rounds):
        sym = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after_star = materialize(small, "small")
        after = _signature(after_star)
        remove(large)
        remove(star)
        star = after_star
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
