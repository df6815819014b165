"""Connected components of a graph of any size, by alternating stars.

Kiveris et al., "Connected components in MapReduce and beyond" (2014): large
stars link each node's larger neighbours to its smallest neighbour, small stars
its smaller neighbours, until nothing changes.  Each round is two aggregates
and joins; a hub's rows are combined before they move and split in the join.
Every few rounds are cut off by a checkpoint in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of orderable nodes -> (node, root), root the smallest node of the component; nodes without an edge are left out."""
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        # rows and order-free sums of the stars tell whether a round changed anything
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
