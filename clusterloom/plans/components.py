"""Connected components by alternating star contractions, as DataFrame joins.

Large star hangs every greater neighbour of a node on the node's least
neighbour, small star does so with the smaller ones. Both keep components as
they are and shorten paths, so that after about log(n) rounds every node hangs
on the least node of its component. No adjacency list is ever built: minima are
combined before the shuffle, and the join back is an equi-join that adaptive
execution can split where a hub has many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.plans.runtime import cut, rekeyed


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(rekeyed(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(rekeyed(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its least node.

    Nulls and loops are no edges; repeated edges count once; no edges give no
    rows. Raises RuntimeError if ``max_rounds`` don't suffice, which takes
    paths of more than 2**30 nodes or so.
    """
    now = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = cut(_small(_large(now)))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mark = tuple(row)
    raise RuntimeError(f"no components after {max_rounds} rounds")
