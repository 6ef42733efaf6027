"""Scoring of attributions ``(graph_id, node_id, truth, score)`` and fragment mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.metrics import metrics, roc_auc
from gneiss.operators.features import wl_key
from gneiss.plans.store import until_settled, written


def merge_bond_scores(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """Node scores and half of each bond's score at either end."""
    half = bonds.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"), (F.col("score") / 2).alias("score"))
    return nodes.select("graph_id", "node_id", "score").unionByName(half).groupBy("graph_id", "node_id").agg(F.sum("score").alias("score"))


def attribution_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Means over graphs where each is defined: AUC, accuracy, F1 and precision."""
    auc = roc_auc(df, ["graph_id"], "truth", "score")
    cut = df.withColumn("score", (F.col("score") > threshold).cast("double"))
    per = metrics(cut, ["graph_id"], ["accuracy", "f1", "precision"], "truth").join(auc, "graph_id")
    return per.agg(*(F.avg(c).alias(c) for c in ("auc", "accuracy", "f1", "precision")))


def attribution_pooled(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row ``auc, accuracy`` over the nodes of all graphs together."""
    one = df.withColumn("_all", F.lit(1))
    cut = one.withColumn("score", (F.col("score") > threshold).cast("double"))
    return roc_auc(one, ["_all"], "truth", "score").join(metrics(cut, ["_all"], ["accuracy"], "truth"), "_all").drop("_all")


def best_threshold(df: DataFrame) -> DataFrame:
    """The median of the thresholds 0.01 to 0.99 with the best mean accuracy of graphs.

    A node is right for the thresholds on one side of its score, so each graph's accuracies come from counts at 99 places, not from 99 copies of the nodes.
    """
    # Thresholds below the score number ceil(score * 100) - 1, within 0 to 99: the node is predicted 1 there.
    below = F.greatest(F.lit(0), F.least(F.lit(99), F.ceil(F.round(F.col("score") * 100, 9)) - 1)).cast("int")
    at = df.groupBy("graph_id", below.alias("b")).agg(F.sum(F.when(F.col("truth") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("truth") == 1, 0).otherwise(1)).alias("n"))
    all_ = df.groupBy("graph_id").agg(F.count("*").alias("size"), F.sum(F.when(F.col("truth") == 1, 1).otherwise(0)).alias("pos"))
    # Right at threshold t: positives with b >= t and negatives with b < t. As a step function: all positives at t = 1, then changes at b + 1.
    start = all_.select((F.col("pos") / F.col("size")).alias("v"), F.lit(1).alias("t"))
    change = at.join(all_, "graph_id").select(((F.col("n") - F.col("p")) / F.col("size")).alias("v"), (F.col("b") + 1).alias("t")).where("t <= 99")
    places = df.sparkSession.range(1, 100).select(F.col("id").cast("int").alias("t"))
    sums = places.join(start.unionByName(change).groupBy("t").agg(F.sum("v").alias("v")), "t", "left").fillna(0.0, ["v"])
    total = F.sum("v").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))  # over 99 rows
    means = sums.select("t", F.round(total, 9).alias("v"))
    best = means.groupBy("v").agg(F.percentile(F.col("t") / 100, F.lit(0.5)).alias("threshold")).orderBy(F.col("v").desc()).limit(1)
    n = all_.count()
    return best.select("threshold", (F.col("v") / F.lit(max(n, 1))).alias("accuracy"))


def mark_atoms(df: DataFrame, threshold: float) -> DataFrame:
    """``mark``: 1 over the threshold, -1 under its negative, else 0."""
    return df.withColumn("mark", F.when(F.col("score") > threshold, 1).when(F.col("score") < -threshold, -1).otherwise(0))


def mark_bonds(bonds: DataFrame, marks: DataFrame) -> DataFrame:
    """``mark`` of a bond: that of both ends if they share it."""
    end = lambda c: marks.select("graph_id", F.col("node_id").alias(c), F.col("mark").alias(f"_{c}"))
    met = bonds.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    return met.select("graph_id", "src", "dst", F.when(F.col("_src") == F.col("_dst"), F.col("_src")).otherwise(0).alias("mark"))


def parts_of(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """``graph_id, node_id, part``: connected parts of chosen nodes within their graphs, named by the smallest node.

    Neighbours' minima, then jumps to the part's part, so that a chain takes rounds in the logarithm of its length.
    """
    chosen = nodes.select("graph_id", "node_id").distinct()
    ends = bonds.select("graph_id", "src", "dst").join(chosen.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(chosen.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    both = written(ends.unionByName(ends.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())

    def step(now: DataFrame) -> DataFrame:
        low = both.join(now.select("graph_id", F.col("node_id").alias("dst"), "part"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.min("part").alias("_m"))
        met = written(now.join(low, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "part", F.least("part", F.coalesce("_m", "part")).alias("_to")))
        # What a part's namesake has found goes to all of the part, and what its new namesake bears.
        hook = met.groupBy("graph_id", F.col("part").alias("_of")).agg(F.min("_to").alias("_h"))
        moved = met.join(hook.withColumnRenamed("_of", "part"), ["graph_id", "part"]).select("graph_id", "node_id", F.least("_to", "_h").alias("part"))
        jump = moved.select("graph_id", F.col("node_id").alias("part"), F.col("part").alias("_j"))
        return moved.join(jump, ["graph_id", "part"]).select("graph_id", "node_id", F.col("_j").alias("part"))

    return until_settled(chosen.withColumn("part", F.col("node_id")), step, lambda df: df.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0])


def top_fragments(nodes: DataFrame, bonds: DataFrame, key: str, eps: float, k: int, least: int = 2) -> DataFrame:
    """``wl, n``: the k most frequent connected parts of at least ``least`` nodes whose scores pass ``eps``."""
    chosen = written(nodes.where(F.abs("score") > eps).select("graph_id", "node_id", key), "chosen")
    parts = parts_of(chosen, bonds)
    big = parts.groupBy("graph_id", "part").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    id_ = F.concat_ws(":", "graph_id", "part")
    held = parts.join(big, ["graph_id", "part"]).join(chosen, ["graph_id", "node_id"])
    inner = bonds.join(parts.select("graph_id", F.col("node_id").alias("src"), "part"), ["graph_id", "src"]).join(parts.select("graph_id", F.col("node_id").alias("dst"), F.col("part").alias("_p")), ["graph_id", "dst"]).where("part = _p")
    keys = wl_key(held.select(id_.alias("graph_id"), "node_id", key), inner.select(id_.alias("graph_id"), "src", "dst"), key)
    return keys.groupBy("wl").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "wl").limit(k)


def evaluate_cliffs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics over both graphs of each pair ``(graph_1, graph_2)``."""
    both = pairs.select(F.explode(F.array("graph_1", "graph_2")).alias("graph_id")).distinct()
    return attribution_metrics(scores.join(both, "graph_id", "left_semi"))


def random_scores(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Scores in [0, 1) from a hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "graph_id", "node_id"))
    return nodes.select("graph_id", "node_id", (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)).alias("score"))


def dot_scores(layers: DataFrame) -> DataFrame:
    """``graph_id, node_id, score``: products of activations and gradients, averaged over layers."""
    one = F.aggregate(F.zip_with("activation", "gradient", lambda a, g: a * g), F.lit(0.0), lambda s, x: s + x)
    return layers.withColumn("_s", one).groupBy("graph_id", "node_id").agg(F.avg("_s").alias("score"))


def path_scores(gradients: DataFrame, steps: int) -> DataFrame:
    """Sum of gradient times difference over a path of ``steps``."""
    return gradients.groupBy("graph_id", "node_id").agg((F.sum(F.col("gradient") * F.col("difference")) / steps).alias("score"))


def pick_rationales(candidates: DataFrame, most: int, delta: float, n: int) -> DataFrame:
    """For each graph the ``n`` smallest candidates of at most ``most`` atoms with a score of ``delta`` or more."""
    w = Window.partitionBy("graph_id").orderBy("size", F.col("score").desc(), "candidate")
    return candidates.where((F.col("size") <= most) & (F.col("score") >= delta)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unique_rationales(df: DataFrame, key: str, roots: str, order: str) -> DataFrame:
    """The first of each key among rationales with a root."""
    w = Window.partitionBy(key).orderBy(order)
    return df.where(F.col(roots) > 0).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def reduce_attention(df: DataFrame) -> DataFrame:
    """Edge weights averaged over heads, then over blocks."""
    return df.groupBy("graph_id", "src", "dst", "block").agg(F.avg("weight").alias("weight")).groupBy("graph_id", "src", "dst").agg(F.avg("weight").alias("weight"))
