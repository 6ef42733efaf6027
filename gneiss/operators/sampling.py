"""Class balance, batches and negative pairs, all from hashes so that they can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.splits import by_class, numbered_non_edges
from gneiss.plans.rank import first_by_hash, first_different_by_hash, hash_order, in_intervals, running_sum, with_index
from gneiss.plans.store import written


def balance_classes(df: DataFrame, id_: str, targets: Sequence[str], seed: int = 0) -> DataFrame:
    """As many positives (any target is 1) as negatives, interleaved: ``place`` 0 is a positive, 1 a negative, and so on."""
    any_ = F.greatest(*(F.coalesce((F.col(t) == 1).cast("int"), F.lit(0)) for t in targets)) if len(targets) > 1 else F.coalesce((F.col(targets[0]) == 1).cast("int"), F.lit(0))
    ranked = by_class(df.withColumn("_pos", any_), id_, "_pos", seed)
    counts = ranked.agg(F.sum("_pos").alias("p"), F.count("*").alias("n")).first()
    least = min(counts["p"] or 0, counts["n"] - (counts["p"] or 0))
    return ranked.where(F.col("_i") < least).withColumn("place", (2 * F.col("_i") + 1 - F.col("_pos")).cast("long")).drop("_i", "_pos")


def shuffled(df: DataFrame, id_: str, seed: int = 0) -> DataFrame:
    """``place``: position in hash order."""
    return with_index(df.withColumn("_h", hash_order(seed, id_)), "_h", id_, name="place").drop("_h")


def batch_ids(df: DataFrame, place: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(place) / size))


def hashed_number(seed: int | str, below: int, *ids: str) -> Column:
    """A whole number under ``below`` from a hash."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 12), 16, 10).cast("long") % below


def neg_local(edges: DataFrame, n_nodes: int, per_edge: int, seed: int = 0) -> DataFrame:
    """``src, dst, k, neg``: for each edge ``per_edge`` hashed destinations in [0, n_nodes), not checked against edges."""
    return edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_edge)))).withColumn("neg", hashed_number(seed, n_nodes, "src", "dst", "k"))


def neg_permuted(negatives: DataFrame, copies: int, seed: int = 0) -> DataFrame:
    """``copy, place, src, dst``: the given pairs, then ``copies - 1`` permutations of them in hash order."""
    out = None
    for c in range(copies):
        order = [hash_order(f"{seed}:{c}", "src", "dst"), "src", "dst"] if c else ["src", "dst"]
        part = with_index(negatives.select("src", "dst"), *order, name="place").select(F.lit(c).alias("copy"), "place", "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


def neg_global(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``place, src, dst``: ``n`` non-edges; where there are fewer, they are taken again from the first on."""
    found = written(numbered_non_edges(edges, nodes, n, seed))
    have = found.count()
    if not have or have >= n:
        return found.select("place", "src", "dst")
    again = F.explode(F.sequence(F.lit(0), F.lit(-(-n // have) - 1)))
    return found.withColumn("_k", again).select((F.col("place") + F.col("_k") * have).alias("place"), "src", "dst").where(F.col("place") < n)


def sample_pairs(factual: DataFrame, counterfactual: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` different pairs ``a, b`` of both tables, the first by a hash."""
    both = factual.select("a", "b").unionByName(counterfactual.select("a", "b"))
    return first_different_by_hash(both, n, seed, "a", "b")


def pos_neg_pairs(edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``src, dst, label`` from positives and, for each source, its stored ``target_node_neg`` array."""
    pos = edges.select("src", "dst", F.lit(1).alias("label"))
    return pos if stored is None else pos.unionByName(stored.select("src", F.explode("target_node_neg").alias("dst"), F.lit(0).alias("label")))


def neg_distribution(edges: DataFrame, power: float = 0.75) -> DataFrame:
    """``node, degree, share, upto``: shares in proportion to degree to a power, and their running sum by node."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    total = degree.agg(F.sum(F.pow("degree", F.lit(power)))).first()[0]
    return running_sum(degree.withColumn("share", F.pow("degree", F.lit(power)) / F.lit(total)), "node", "share", "upto")


def draw_nodes(edges: DataFrame, n: int, power: float = 0.75, seed: int = 0) -> DataFrame:
    """``n`` nodes drawn from :func:`neg_distribution`: hashed numbers joined with the shares' intervals.

    Shares are whole numbers of 2**-48, one at least, so that their running sum is exact and leaves no gaps.
    """
    weights = neg_distribution(edges, power).select("node", F.greatest(F.round(F.col("share") * float(1 << 48)), F.lit(1)).cast("long").alias("weight"))
    bounds = written(running_sum(weights, "node", "weight", "high").withColumn("low", F.col("high") - F.col("weight")))
    nodes, total = bounds.agg(F.count("*"), F.sum("weight")).first()
    draws = edges.sparkSession.range(n).withColumn("slot", F.conv(F.substring(hash_order(seed, "id"), 1, 15), 16, 10).cast("long") % F.lit(total or 1))
    return in_intervals(draws, "slot", bounds.select("node", "low", "high"), "low", "high", (total or 1) // min(nodes or 1, 1 << 20)).select("id", "node")


def hash_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows without replacement, the first in hash order of ``ids``; of rows with equal ids that only some fit, any."""
    return first_by_hash(df, n, seed, *ids)
