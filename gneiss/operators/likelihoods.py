"""Log-likelihoods of a partition under block models, for edges ``(src, dst, w)`` with ``w`` as multiplicity and ``(node, block)``.

Each is a sum of independent terms, and each term a small aggregate of the edges or of the partition; the terms are
united and added, so no node-by-node matrix and no cross join is made. Nodes of ``part`` without edges count as nodes
of degree nought.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gneiss.functions.mathx import lgamma, log_binomial, log_factorial, log_partitions
from gneiss.operators.blocks import block_edges, block_stats
from gneiss.plans.store import written


def _added(terms: list[DataFrame], fixed: float = 0.0) -> DataFrame:
    """One row ``score``: the sum of all rows of all terms and ``fixed``."""
    return reduce(DataFrame.unionByName, terms).agg((F.coalesce(F.sum("score"), F.lit(0.0)) + fixed).alias("score"))


def _term(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.sum(value).cast("double").alias("score"))


def _log_binomial(n: float, k: float) -> float:
    return 0.0 if k >= n else math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _multisets(n: Column, k: Column) -> Column:
    """Logarithm of the number of ways to deal ``k`` like things to ``n`` places."""
    n, k = n.cast("double"), k.cast("double")
    return F.when(n > 0, log_binomial(n + k - 1, k)).otherwise(0.0)


def _twice(x: Column) -> Column:
    """Logarithm of ``(2x)!!``."""
    return x * math.log(2) + lgamma(x + 1)


@F.pandas_udf(DoubleType())
def _log_q(m: pd.Series, n: pd.Series) -> pd.Series:
    """Per block only, so on as many rows as the model has blocks."""
    return pd.Series([log_partitions(int(a), int(b)) for a, b in zip(m, n, strict=True)], dtype="float64")


def _grid(edges: DataFrame, part: DataFrame, directed: bool) -> DataFrame:
    """``r, s, a, b, e`` for all block pairs (undirected: r <= s) with sizes a and b; pairs without edges have e = 0. Blocks are few: their square is the model's own size."""
    sizes = part.groupBy("block").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    pairs = sizes.select("_one", F.col("block").alias("r"), F.col("n").alias("a")).join(sizes.select("_one", F.col("block").alias("s"), F.col("n").alias("b")), "_one").drop("_one")
    return (pairs if directed else pairs.where("r <= s")).join(block_edges(edges, part, directed), ["r", "s"], "left").fillna(0, ["e"])


def newman_reinert(edges: DataFrame, part: DataFrame, directed: bool = False, corrected: bool = False) -> DataFrame:
    """One row ``score``: integrated likelihood of a partition and its number of blocks, with or without degree correction."""
    stats = written(block_stats(edges, part))
    n, blocks = stats.agg(F.sum("size"), F.count("*")).first()
    p = (1.0 if directed else 2.0) * edges.agg(F.sum("w")).first()[0] / (n * n)
    half = F.lit(1.0) if directed else F.when(F.col("r") == F.col("s"), 0.5).otherwise(1.0)
    cells = _term(_grid(edges, part, directed), log_factorial(F.col("e")) - (F.col("e") + 1) * F.log(half * p * F.col("a") * F.col("b") + 1))
    size, degree = F.col("size").cast("double"), F.col("degree").cast("double")
    of_block = log_factorial(size)
    if corrected:
        of_block = of_block + degree * F.log(size) + lgamma(size) - lgamma(size + degree)
    return _added([cells, _term(stats, of_block)], -math.log(n) + math.lgamma(blocks) - math.lgamma(blocks + n))


def _degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree``."""
    ends = edges.select(F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.col("w").alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _adjacency(edges: DataFrame, part: DataFrame, stats: DataFrame, directed: bool, corrected: bool) -> list[DataFrame]:
    """Terms of the graph's likelihood, given the counts of edges between blocks (and, if corrected, the nodes' degrees)."""
    e, a = F.col("e").cast("double"), F.col("a").cast("double")
    if directed:
        inner = _term(block_edges(edges, part, True), lgamma(e + 1))
        pairs = _term(edges.groupBy("src", "dst").agg(F.sum("w").alias("a")), -lgamma(a + 1))
    else:
        inner = _term(block_edges(edges, part).where("r <= s"), F.when(F.col("r") == F.col("s"), _twice(e / 2)).otherwise(lgamma(e + 1)))
        pairs = edges.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.sum("w").alias("a"))
        pairs = _term(pairs, -F.when(F.col("i") == F.col("j"), _twice(a)).otherwise(lgamma(a + 1)))
    if not corrected:
        return [inner, pairs, _term(stats, -F.col("degree") * F.log("size"))]
    ends = log_factorial(F.col("out_degree")) + log_factorial(F.col("in_degree")) if directed else log_factorial(F.col("out_degree") + F.col("in_degree"))
    return [inner, pairs, _term(_degrees(edges), ends), _term(stats, -ends)]


def _degree_prior(edges: DataFrame, part: DataFrame, stats: DataFrame, directed: bool, degrees: str | None) -> list[DataFrame]:
    """Terms of the degrees' likelihood: none without correction; any degrees alike; or any distributions of degrees alike."""
    if degrees is None:
        return []
    sums = [F.col("out_degree"), F.col("in_degree")] if directed else [F.col("degree")]
    if degrees == "uniform":
        return [_term(stats, sum((-_multisets(F.col("size"), d) for d in sums), F.lit(0.0)))]
    if degrees != "hyperprior":
        raise ValueError(f"unknown degree prior: {degrees}")
    ways = stats.select((-sum((_log_q(d.cast("long"), F.col("size")) for d in sums), F.lit(0.0)) - log_factorial(F.col("size"))).alias("score"))
    keys = ["out_degree", "in_degree"] if directed else [(F.col("out_degree") + F.col("in_degree")).alias("k")]
    met = part.join(_degrees(edges), "node", "left").fillna(0, ["out_degree", "in_degree"])
    return [ways, _term(met.groupBy("block", *keys).agg(F.count("*").alias("c")), log_factorial(F.col("c")))]


def _partition_prior(below: int, blocks: int) -> float:
    """What the prior of a partition of ``below`` things into ``blocks`` blocks adds to the sum of ``log n_r!``."""
    return -math.lgamma(1 + below) - _log_binomial(below - 1, blocks - 1) - math.log(below)


def _count_prior(blocks: int, m: float, directed: bool) -> float:
    cells = blocks * blocks if directed else blocks * (blocks + 1) / 2
    return -_log_binomial(cells + m - 1, m)


def flat_likelihood(edges: DataFrame, part: DataFrame, degrees: str | None = None, directed: bool = False) -> DataFrame:
    """One row ``score``: microcanonical log-likelihood of a multigraph and its partition.

    ``degrees``: None (no degree correction), ``uniform`` or ``hyperprior``.
    """
    stats = written(block_stats(edges, part))
    n, blocks = stats.agg(F.sum("size"), F.count("*")).first()
    m = float(edges.agg(F.sum("w")).first()[0])
    terms = _adjacency(edges, part, stats, directed, degrees is not None) + _degree_prior(edges, part, stats, directed, degrees)
    return _added([*terms, _term(stats, log_factorial(F.col("size")))], _count_prior(blocks, m, directed) + _partition_prior(n, blocks))


def hierarchy_likelihood(edges: DataFrame, levels: list[DataFrame], degrees: str | None = None, directed: bool = False) -> DataFrame:
    """One row ``score``: microcanonical log-likelihood of a multigraph and a hierarchy of partitions.

    The first of ``levels`` partitions the nodes, each other one the blocks of the level below; one block over all is
    the top and isn't given. A level's graph is the table of block counts below it, so each level is smaller than the
    one before.
    """
    stats = written(block_stats(edges, levels[0]))
    m = float(edges.agg(F.sum("w")).first()[0])
    terms = _adjacency(edges, levels[0], stats, directed, degrees is not None) + _degree_prior(edges, levels[0], stats, directed, degrees)
    now, fixed, blocks = edges, 0.0, 0
    for part in levels:
        raw = written(block_edges(now, part, True))
        sizes = written(part.groupBy("block").agg(F.count("*").alias("size")))
        below, blocks = sizes.agg(F.sum("size"), F.count("*")).first()
        now = raw.select(F.col("r").alias("src"), F.col("s").alias("dst"), F.col("e").alias("w"))
        side = lambda c, name: sizes.select(F.col("block").alias(c), F.col("size").cast("double").alias(name))  # noqa: B023, E731
        both = raw if directed else raw.groupBy(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).agg(F.sum("e").alias("e"))
        places = F.col("a") * F.col("b") if directed else F.when(F.col("r") == F.col("s"), F.col("a") * (F.col("a") + 1) / 2).otherwise(F.col("a") * F.col("b"))
        # A pair of blocks without edges has one way, so only those with edges count.
        terms += [_term(both.join(side("r", "a"), "r").join(side("s", "b"), "s"), -_multisets(places, F.col("e"))), _term(sizes, log_factorial(F.col("size")))]
        fixed += _partition_prior(below, blocks)
    return _added(terms, fixed + _count_prior(blocks, m, directed) - math.log(blocks))


def icl(edges: DataFrame, part: DataFrame, prior: float = 0.5, directed: bool = False) -> DataFrame:
    """One row ``score``: exact integrated likelihood of a graph without repeated edges; loops are allowed.

    A Beta prior (0.5: Jeffreys; 1: uniform) on each of all block pairs, empty ones too, and a Dirichlet prior on sizes.
    """
    ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    once = edges.select(ends[0].alias("src"), ends[1].alias("dst")).distinct().withColumn("w", F.lit(1))
    stats = written(part.groupBy("block").agg(F.count("*").alias("size")))
    n, blocks = stats.agg(F.sum("size"), F.count("*")).first()
    same = F.lit(not directed) & (F.col("r") == F.col("s"))
    e = F.col("e") / F.when(same, 2.0).otherwise(1.0)
    places = F.when(same, F.col("a") * (F.col("a") + 1) / 2).otherwise(F.col("a") * F.col("b")).cast("double")
    cell = lgamma(e + prior) + lgamma(places - e + prior) - lgamma(places + 2 * prior) + (math.lgamma(2 * prior) - 2 * math.lgamma(prior))
    fixed = math.lgamma(blocks * prior) - blocks * math.lgamma(prior) - math.lgamma(n + blocks * prior)
    return _added([_term(_grid(once, part, directed), cell), _term(stats, lgamma(F.col("size") + prior))], fixed)


def description_length(edges: DataFrame, part: DataFrame, directed: bool = False, corrected: bool = False) -> DataFrame:
    """One row ``score``: what the MDL criterion takes off a score for a partition, up to a constant of the graph.

    With degree correction, also each block's size times the entropy of its nodes' degrees (directed: of out and in).
    """
    stats = written(part.groupBy("block").agg(F.count("*").alias("size")))
    n, blocks = stats.agg(F.sum("size"), F.count("*")).first()
    m = float(edges.agg(F.sum("w")).first()[0])
    terms = [_term(stats, -log_factorial(F.col("size")))]
    if corrected:
        met = written(part.join(_degrees(edges), "node", "left").fillna(0, ["out_degree", "in_degree"]))
        for k in [F.col("out_degree"), F.col("in_degree")] if directed else [F.col("out_degree") + F.col("in_degree")]:
            counts = met.groupBy("block", k.alias("k")).agg(F.count("*").alias("c")).join(stats, "block")
            terms.append(_term(counts, -F.col("c") * F.log(F.col("c") / F.col("size"))))
    return _added(terms, _log_binomial(blocks + n - 1, n) - _count_prior(blocks, m, directed))
