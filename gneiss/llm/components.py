"""Connected components by alternating large-star and small-star, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    near = both.join(least, "u").where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``: the smallest node that can be reached.

    Loops, repeats and both directions of an edge are harmless; null ends are left out. Each round is
    written to the shared folder, so a lost executor costs at most one round. A round's two joins are plain
    equi-joins, whose hot keys adaptive execution splits. Ends when a round changes nothing.
    """
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    seen = None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == seen:
            break
        seen = row
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
