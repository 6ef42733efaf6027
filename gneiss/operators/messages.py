"""Message passing and readout without learned weights, over ``nodes(graph_id, node_id, x array)`` and bonds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.features import adjacency

_FOLDS = {"sum": F.sum, "mean": F.avg, "max": F.max}


def _arrays(flat: DataFrame, keys: Sequence[str], how: str, name: str = "x") -> DataFrame:
    """Element-wise folds of arrays given as ``keys, at, v``."""
    per = flat.groupBy(*keys, "at").agg(_FOLDS[how]("v").alias("v"))
    return per.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias(name))


def propagate(nodes: DataFrame, bonds: DataFrame, how: str = "sum", hops: int = 1) -> DataFrame:
    """``x`` folded over neighbours, ``hops`` times; a node without neighbours gets zeros."""
    near = adjacency(nodes.limit(0), bonds)
    now = nodes.select("graph_id", "node_id", F.col("x").cast("array<double>").alias("x"))
    for _ in range(hops):
        flat = near.join(now.select("graph_id", F.col("node_id").alias("j"), "x"), ["graph_id", "j"]).select("graph_id", F.col("i").alias("node_id"), F.posexplode("x").alias("at", "v"))
        got = _arrays(flat, ["graph_id", "node_id"], how, "y")
        now = now.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("y", F.transform("x", lambda v: F.lit(0.0))).alias("x"))
    return now


def propagate_norm(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """Sum over neighbours and self, over the number of them."""
    near = adjacency(nodes, bonds)
    flat = near.join(nodes.select("graph_id", F.col("node_id").alias("j"), "x"), ["graph_id", "j"]).select("graph_id", F.col("i").alias("node_id"), F.posexplode("x").alias("at", "v"))
    return _arrays(flat, ["graph_id", "node_id"], "mean")


def bond_message_step(directed: DataFrame, messages: DataFrame) -> DataFrame:
    """``graph_id, bond_id, m``: the sum of what comes into a bond's source, less what its reverse brings; messages are ``(graph_id, bond_id, m)`` numbers."""
    met = directed.join(messages, ["graph_id", "bond_id"])
    into = met.groupBy("graph_id", F.col("dst").alias("src")).agg(F.sum("m").alias("all"))
    back = met.select("graph_id", F.col("rev_id").alias("bond_id"), F.col("m").alias("own"))
    return directed.join(into, ["graph_id", "src"], "left").join(back, ["graph_id", "bond_id"], "left").select("graph_id", "bond_id", (F.coalesce("all", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))).alias("m"))


def average_reverse(directed: DataFrame, messages: DataFrame) -> DataFrame:
    met = directed.select("graph_id", "bond_id", "rev_id").join(messages, ["graph_id", "bond_id"])
    back = met.select("graph_id", F.col("rev_id").alias("bond_id"), F.col("m").alias("_b"))
    return met.join(back, ["graph_id", "bond_id"]).select("graph_id", "bond_id", ((F.col("m") + F.col("_b")) / 2).alias("m"))


def readout(graphs: DataFrame, nodes: DataFrame, how: str = "mean", width: int = 1, norm: float = 100.0) -> DataFrame:
    """``graph_id, x`` for every graph: sum, mean, max or norm (sum over a constant); zeros for an empty one."""
    flat = nodes.select("graph_id", F.posexplode("x").alias("at", "v"))
    got = _arrays(flat, ["graph_id"], "sum" if how == "norm" else how)
    if how == "norm":
        got = got.withColumn("x", F.transform("x", lambda v: v / norm))
    return graphs.select("graph_id").distinct().join(got, "graph_id", "left").select("graph_id", F.coalesce("x", F.array_repeat(F.lit(0.0), width)).alias("x"))


def sort_pool(nodes: DataFrame, k: int) -> DataFrame:
    """``graph_id, x``: the k nodes with the largest last element, largest first, end to end, padded with zeros."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.element_at("x", -1).desc(), "node_id"))
    top = nodes.withColumn("_r", rank).where(F.col("_r") <= k)
    held = top.groupBy("graph_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_r", "x"))), lambda p: p["x"])).alias("x"), F.max(F.size("x")).alias("_w"))
    return held.select("graph_id", F.concat("x", F.array_repeat(F.lit(0.0), (F.lit(k) * F.col("_w") - F.size("x")).cast("int"))).alias("x"))


def jump(layers: Sequence[Column], how: str = "sum") -> Column:
    """Layers' arrays combined: concat, sum, mean or max."""
    if how == "concat":
        return F.concat(*layers)
    out = layers[0]
    for layer in layers[1:]:
        out = F.zip_with(out, layer, (lambda a, b: F.greatest(a, b)) if how == "max" else (lambda a, b: a + b))
    return F.transform(out, lambda v: v / len(layers)) if how == "mean" else out


def softmax(arr: Column) -> Column:
    top = F.array_max(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(arr, lambda x: F.exp(x - top) / total)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def fill_unseen(keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """``node, v``: each key's vector, or the mean of all."""
    per = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    mean = per.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return keys.join(vectors.select("node", "v"), "node", "left").join(F.broadcast(mean)).select("node", F.coalesce("v", "mean").alias("v"))


def mean_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root of the mean squared difference of two tables' mean vectors, with 1e-6 under the root."""
    mean = lambda df, n: df.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias(n))
    return mean(a, "p").join(mean(b, "q"), "at").agg(F.sqrt(F.avg((F.col("p") - F.col("q")) ** 2) + 1e-6).alias("gap"))
