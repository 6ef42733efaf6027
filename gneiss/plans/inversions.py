"""Inversions between two orders of a table, counted by group, where a group may be far larger than a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 17


def weighted_inversions(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the weight of the rows before it that have a greater ``rank``, times its own weight.

    From the highest bit of the ranks down: rows that share all higher bits stand together in their first order, and one with a 0 in
    the bit counts those with a 1 before it. Equal ranks count nothing.
    """
    rank = np.unique(rank, return_inverse=True)[1]
    order, out = np.arange(len(rank)), np.zeros(len(rank), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        r = rank[order]
        one = (r >> bit) & 1
        upto = np.cumsum(weight[order] * one)
        begins = np.flatnonzero(np.diff(r >> (bit + 1), prepend=-1))
        before = np.where(begins > 0, upto[begins - 1], 0)
        zero = one == 0
        out[order[zero]] += (upto - np.repeat(before, np.diff(np.append(begins, len(r)))))[zero]
        order = order[np.argsort(r >> bit, kind="stable")]
    return out * weight


def _counter(first: list[str]):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(first)
        found = weighted_inversions(rows["b"].to_numpy(), rows["w"].to_numpy())
        return pd.DataFrame({"group": rows["group"].to_numpy(), "inversions": found}).groupby("group", as_index=False).sum()

    return count


def count_inversions(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``group, inversions`` over rows ``(group, a, b, w)``: the sum of ``w * w'`` over pairs with ``a < a'`` and ``b > b'``.

    ``a`` and ``b`` are positions 0, 1, ... of all rows in two orders that both sort by group first, so a group takes up the same stretch in
    both and no pair between groups is inverted. Positions are cut into blocks of ``block``. A pair in one block of ``a`` is counted there; one
    in different blocks of ``a`` but one of ``b`` there; all others from the weights of (block of ``a``, block of ``b``), by running sums over
    the grid of a group's blocks. A task holds one block or one line of a grid.
    """
    cut = df.withColumn("ab", F.floor(F.col("a") / block)).withColumn("bb", F.floor(F.col("b") / block))
    schema = "group long, inversions long"
    inside = cut.select("group", "ab", "a", "b", "w").groupBy("ab").applyInPandas(_counter(["a"]), schema)
    wide = cut.groupBy("group").agg(F.min("ab").alias("lo"), F.max("ab").alias("hi")).where("lo < hi")
    spread = cut.join(wide, "group").select("group", "ab", "bb", "b", "w")
    # Rows of one block of ``a`` go up by ``b``, so no pair of them is counted a second time.
    beside = spread.select("group", "bb", "ab", "b", "w").groupBy("bb").applyInPandas(_counter(["ab", "b"]), schema)
    axis = F.sequence("lo", "hi")
    empty = wide.select("group", F.explode(axis).alias("ab"), "lo", "hi").select("group", "ab", F.explode(axis).alias("bb"), F.lit(0).cast("long").alias("w"))
    cells = spread.select("group", "ab", "bb", "w").unionByName(empty).groupBy("group", "ab", "bb").agg(F.sum("w").alias("w"))
    beyond = Window.partitionBy("group", "ab").orderBy(F.col("bb").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("group", "bb").orderBy("ab").rowsBetween(Window.unboundedPreceding, -1)
    summed = cells.withColumn("s", F.coalesce(F.sum("w").over(beyond), F.lit(0))).withColumn("p", F.coalesce(F.sum("s").over(above), F.lit(0)))
    across = summed.select("group", (F.col("w") * F.col("p")).alias("inversions"))
    return inside.unionByName(beside).unionByName(across).groupBy("group").agg(F.sum("inversions").alias("inversions"))
