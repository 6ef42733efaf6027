"""Graph operators over edge tables ``(src, dst, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import strips
from gneiss.operators.nearest import distance, distance_threshold, dot, knn  # noqa: F401  the last for callers of this module
from gneiss.operators.products import products
from gneiss.plans.rank import running_sum
from gneiss.plans.store import until_settled, written


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge and its inverse; a loop once."""
    return edges.select("src", "dst", *keep).unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in either direction, without loops."""
    return both_ways(edges.where("src <> dst")).distinct()


def add_inverse(edges: DataFrame, order: str) -> DataFrame:
    """Each edge at place ``2 * order`` and its inverse right after it."""
    pair = F.array(F.struct((2 * F.col(order)).alias("place"), F.col("src"), F.col("dst")), F.struct((2 * F.col(order) + 1).alias("place"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    rest = [c for c in edges.columns if c not in ("src", "dst", order)]
    return edges.select(*rest, F.explode(pair).alias("x")).select("x.*", *rest)


def coalesce_edges(edges: DataFrame, weight: str = "w") -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias(weight))


def to_undirected(edges: DataFrame, weight: str = "w") -> DataFrame:
    return coalesce_edges(both_ways(edges, weight), weight)


def set_loops(edges: DataFrame, nodes: DataFrame, weight: float = 1.0) -> DataFrame:
    """Edges without their loops, and one loop at each node."""
    return edges.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(weight).alias("w")))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, weight: str = "w") -> DataFrame:
    """``node, out_degree, in_degree, degree, strength``."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    flat = edges.select(F.explode(ends).alias("x"), F.col(weight).alias("w")).select("x.*", "w")
    return flat.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"), F.sum("w").alias("strength"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, undirected edges without loops, and density."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n, m = nodes_of(edges).agg(F.count("*").alias("n_nodes")), pairs.agg(F.count("*").alias("n_edges"))
    return n.join(F.broadcast(m)).select("n_nodes", "n_edges", (2 * F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(0))).alias("density"))


def _with_degree(edges: DataFrame, degree: DataFrame, side: str) -> DataFrame:
    return edges.join(degree.select(F.col("node").alias(side), F.col("d").alias(f"d_{side}")), side)


def normalize_weights(edges: DataFrame) -> DataFrame:
    """``w / sqrt(d_src * d_dst)`` with degrees counted at the source."""
    d = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    met = edges.join(d.select(F.col("node").alias("src"), F.col("d").alias("a")), "src", "left").join(d.select(F.col("node").alias("dst"), F.col("d").alias("b")), "dst", "left")
    return met.select("src", "dst", F.coalesce(F.col("w") / F.sqrt(F.col("a") * F.col("b")), F.lit(0.0)).alias("w"))


def gcn_norm(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of ``D^-1/2 (A + I) D^-1/2``."""
    return normalize_weights(set_loops(edges, nodes))


def row_norm(edges: DataFrame) -> DataFrame:
    d = edges.groupBy("src").agg(F.sum("w").alias("d"))
    return edges.join(d, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """Entries of ``I - D^-1/2 A D^-1/2`` for symmetric edges without loops."""
    off = normalize_weights(edges).select("src", "dst", (-F.col("w")).alias("w"))
    return off.unionByName(edges.select(F.col("src").alias("node")).distinct().select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))


def kcore(edges: DataFrame) -> DataFrame:
    """``node, core``: each node's bound falls to the largest h with h neighbours of bound h or more, until nothing falls."""
    near = written(neighbours(edges))
    start = near.groupBy("src").agg(F.count("*").alias("core")).withColumnRenamed("src", "node")

    def step(now: DataFrame) -> DataFrame:
        # Merged: a broadcast in each round would send the table through the driver each time.
        met = near.join(now.select(F.col("node").alias("dst"), F.col("core").alias("c")).hint("merge"), "dst")
        counts = met.join(now.select(F.col("node").alias("src"), "core").hint("merge"), "src").groupBy("src", "core", F.least("c", "core").alias("h")).agg(F.count("*").alias("n"))
        down = Window.partitionBy("src").orderBy(F.col("h").desc()).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("upto", F.sum("n").over(down)).groupBy(F.col("src").alias("node")).agg(F.max(F.least("h", "upto")).alias("core"))

    return until_settled(start, step, lambda df: df.agg(F.sum("core")).first()[0])


def hops_from(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """``node, dist`` of all that is within ``most`` hops of ``start(node)``; the frontier is joined, level by level."""
    near = neighbours(edges)
    reached = written(start.select("node", F.lit(0).alias("dist")))
    k = 0
    while most is None or k < most:
        front = reached.where(F.col("dist") == k).select(F.col("node").alias("src")).join(near, "src").select(F.col("dst").alias("node")).distinct()
        new = written(front.join(reached, "node", "left_anti").select("node", F.lit(k + 1).alias("dist")))
        if new.isEmpty():
            break
        reached, k = reached.unionByName(new), k + 1
    return reached


def anchor_ball(edges: DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` hops of the node of largest degree (ties: the smallest)."""
    hub = neighbours(edges).groupBy(F.col("src").alias("node")).count().orderBy(F.col("count").desc(), "node").limit(1)
    return hops_from(edges, hub, k)


def _sets(near: DataFrame) -> DataFrame:
    """Neighbours as ``node, item`` for :func:`gneiss.operators.products.products`."""
    return near.select(F.col("src").alias("node"), F.col("dst").alias("item"))


def wedge_counts(edges: DataFrame, least: int = 1) -> DataFrame:
    """``a, b, common``: pairs of nodes with ``least`` or more common neighbours, counted block by block."""
    return products(_sets(neighbours(edges)), keep=lambda da, db, n: n >= least).select("a", "b", F.col("value").cast("long").alias("common"))


def jaccard(edges: DataFrame, percentile: float | None = None) -> DataFrame:
    """``a, b, similarity`` of neighbour sets; with ``percentile``, pairs at or above that share of the similarities."""
    sims = products(_sets(neighbours(edges))).select("a", "b", (F.col("value") / (F.col("da") + F.col("db") - F.col("value"))).alias("similarity"))
    if percentile is None:
        return sims
    sims = written(sims)
    return sims.where(F.col("similarity") >= quantile(sims, "similarity", percentile))


def jaccard_join(edges: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` of all pairs ``a < b`` whose neighbour sets have a Jaccard similarity of ``least`` (above 0) or more.

    Neighbours are ordered from the rarest to the commonest. Two sets that are alike share one of the first ``d - ceil(least * d) + 1`` of
    each, so only those are indexed: a hub is last in all sets and hardly ever meets all that it joins. Candidates also need sizes
    in proportion, and are counted along the smaller set's neighbours by an equi-join. Long lists are split by adaptive execution. Where
    prefixes leave more than a sixteenth of the pairs of neighbours, as under low similarities, sets are compared block by block instead.
    """
    near = written(neighbours(edges))
    degree = near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    size = lambda name, d: degree.select(F.col("node").alias(name), F.col("d").alias(d))
    placed = near.join(size("dst", "df"), "dst").join(size("src", "d"), "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("df", "dst"))
    first = written(placed.withColumn("i", place).where(F.col("i") <= F.col("d") - F.ceil(F.col("d") * least - 1e-9) + 1).select("src", "dst", "d", "i"))
    met = lambda df: df.groupBy("dst").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if met(first) * 16 > met(near):
        sims = products(_sets(near), keep=lambda da, db, n: n / (da + db - n) >= least)
        return sims.select("a", "b", (F.col("value") / (F.col("da") + F.col("db") - F.col("value"))).alias("similarity"))
    side = lambda n: first.select("dst", F.col("src").alias(n), F.col("d").alias(f"d{n}"), F.col("i").alias(f"i{n}"))
    # What follows both places bounds what can still be shared.
    rest = 1 + F.least(F.col("da") - F.col("ia"), F.col("db") - F.col("ib")) + F.least("ia", "ib") - 1
    fits = (F.least("da", "db") >= least * F.greatest("da", "db") - 1e-9) & (rest * (1 + least) >= least * (F.col("da") + F.col("db")) - 1e-9)
    pairs = side("a").join(side("b"), "dst").where("a < b").where(fits).select("a", "b", "da", "db").distinct()
    pairs = written(pairs.select("a", "b", "da", "db", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("v")))
    met = pairs.join(near.select(F.col("src").alias("u"), F.col("dst").alias("m")), "u").join(near.select(F.col("src").alias("v"), F.col("dst").alias("m")), ["v", "m"])
    counts = met.groupBy("a", "b", "da", "db").agg(F.count("*").alias("common"))
    return counts.select("a", "b", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least)


def quantile(df: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile, between two values in proportion, from the counts of different values: those are summed, never held in one task."""
    counts = running_sum(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_upto")
    counts = written(counts)
    n = counts.agg(F.max("_upto")).first()[0]
    if not n:
        return None
    at = share * (n - 1)
    pick = lambda k: counts.where(F.col("_upto") > k).agg(F.min(value)).first()[0]
    low = pick(int(at))
    return low + (pick(min(int(at) + 1, n - 1)) - low) * (at - int(at))


def katz(edges: DataFrame, beta: float, terms: int) -> DataFrame:
    """``src, dst, w``: the sum of ``beta**l * A**l`` up to ``terms``, by repeated products that count walks; in a dense graph strip by strip."""
    near = written(neighbours(edges))
    if terms > 2 and strips.is_dense(near):
        return strips.katz(near, float(beta), terms)
    power = _sets(near).withColumn("w", F.lit(1.0))
    total = near.select("src", "dst", F.lit(float(beta)).alias("w"))
    for length in range(2, terms + 1):
        power = written(products(power, _sets(near)).select(F.col("a").alias("node"), F.col("b").alias("item"), F.col("value").alias("w")))
        total = total.unionByName(power.select(F.col("node").alias("src"), F.col("item").alias("dst"), (F.col("w") * float(beta) ** length).alias("w")))
    return total.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def largest_eigenvalue(edges: DataFrame, rounds: int = 10) -> float:
    """Of the adjacency, by power iteration."""
    near = written(neighbours(edges))
    v = near.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0))
    value = 0.0
    for _ in range(rounds):
        v = written(near.join(v.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("x").alias("x")))
        value = v.agg(F.max("x")).first()[0] or 0.0
        v = v.withColumn("x", F.col("x") / F.lit(value or 1.0))
    return value


def katz_treatment(edges: DataFrame, k: int, terms: int = 3) -> DataFrame:
    """``a, b, w``: pairs ``a < b`` whose Katz similarity reaches ``2 * k * total / (n * n - 1)``, where ``total`` sums all similarities of ``n`` nodes.

    ``beta`` is half the inverse of the largest eigenvalue, 0.003 at most.
    """
    largest = largest_eigenvalue(edges, 30)
    sims = written(katz(edges, min(1 / (2 * largest), 0.003) if largest else 0.003, terms))
    n, total = nodes_of(edges).count(), sims.agg(F.sum("w")).first()[0] or 0.0
    return sims.where((F.col("src") < F.col("dst")) & (F.col("w") >= 2 * k * total / max(1, n * n - 1))).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")


def union_edges(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges of both parts, each with its own weight; 1 where a part has none."""
    weighted = lambda df: df.select("src", "dst", F.col("w").cast("double") if "w" in df.columns else F.lit(1.0).alias("w"))
    return weighted(train).unionByName(weighted(valid))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """``node, block``: in each round a node takes its neighbours' most frequent label, the smallest of equal ones."""
    near = written(neighbours(edges))
    now = near.select(F.col("src").alias("node")).distinct().withColumn("block", F.col("node"))
    for _ in range(rounds):
        votes = near.join(now.select(F.col("node").alias("dst"), "block"), "dst").groupBy("src", "block").agg(F.count("*").alias("n"))
        now = written(votes.groupBy(F.col("src").alias("node")).agg(F.max_by("block", F.struct("n", -F.col("block"))).alias("block")))
    return now


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that can be reached; neighbours' minima, with jumps to the label's label."""
    near = written(neighbours(edges))
    start = near.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component"))

    def step(now: DataFrame) -> DataFrame:
        low = near.join(now.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        met = now.join(low, "node").select("node", F.least("component", "m").alias("component"))
        jump = met.select(F.col("node").alias("component"), F.col("component").alias("to"))
        return met.join(jump, "component").select("node", F.col("to").alias("component"))

    return until_settled(start, step, lambda df: df.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0])


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Of an undirected simple graph under ``partition(node, block)``."""
    near = neighbours(edges)
    met = near.join(partition.select(F.col("node").alias("src"), F.col("block").alias("r")), "src").join(partition.select(F.col("node").alias("dst"), F.col("block").alias("s")), "dst")
    per = met.groupBy("r").agg(F.sum((F.col("r") == F.col("s")).cast("double")).alias("inside"), F.count("*").alias("ends"))
    m2 = per.agg(F.sum("ends")).first()[0]
    return per.agg(F.sum(F.col("inside") / m2 - (F.col("ends") / m2) ** 2).alias("modularity"))


def _looked(near: DataFrame, state: DataFrame, m2: float) -> tuple[DataFrame, float, int]:
    """``state(node, block, d, parts)`` and the neighbouring block ``to`` with the largest gain, if a node gains; modularity; how many nodes gain."""
    from gneiss.operators.parts import visited

    # Merged: a broadcast in each round would send the table through the driver each time.
    sizes = state.groupBy("block").agg(F.sum("d").alias("size"))
    sized = state.join(sizes.hint("merge"), "block")

    def gains(part, ends: pa.Table, own: pa.Array) -> pa.Table:
        block, size, d = (ends.column(c).to_numpy() for c in ("block", "size", "d"))
        rows = part.rows
        names, of = np.unique(block, return_inverse=True)
        inside = np.bincount(part.src, part.w * (of[part.at] == of[rows][part.src]), len(rows))
        link = np.flatnonzero(part.at != rows[part.src])
        key = part.src[link] * len(names) + of[part.at[link]]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        best, stay = np.full(len(rows), -1), -d[rows] * (size[rows] - d[rows]) / m2
        if len(first):
            k, node, to = np.add.reduceat(part.w[link][order], first), *np.divmod(key[order][first], len(names))
            over, alike = d[rows][node], to == of[rows][node]
            gain = k - over * (size[part.at[link][order][first]] - np.where(alike, over, 0)) / m2
            # A node without edges inside its block has its own degree to set against.
            stay[node[alike]] = gain[alike]
            ranked = np.lexsort((to, -gain, node))
            top = ranked[np.flatnonzero(np.diff(node[ranked], prepend=-1))]
            top = top[gain[top] > stay[node[top]] + 1e-12]
            best[node[top]] = to[top]
        to = pa.array(names[np.maximum(best, 0)] if len(names) else best, mask=best < 0)
        here = ends.select(["node", "block", "d", "parts"]).take(own)
        return here.append_column("to", to).append_column("inside", pa.array(inside)).append_column("size", pa.array(size[rows]))

    looked = visited(near, sized, ["block", "size", "d"], [], gains, "node long, block long, d double, parts array<long>, to long, inside double, size double")
    now = written(looked)
    inside, square, gaining = now.agg(F.sum("inside"), F.sum(F.col("d") * F.col("size")), F.count("to")).first()
    return now, (inside or 0.0) / m2 - (square or 0.0) / m2 / m2, gaining


def _moved(near: DataFrame, state: DataFrame, m2: float, least: float) -> DataFrame:
    """Rounds of synchronous moves to the neighbouring block with the largest gain, as long as modularity rises by ``least``.

    A round moves all nodes that gain; if that lowers modularity, as when two swap, half of them by a hash, a quarter, and so on. The same visit of
    all edges gives a round's modularity and the next one's moves.
    """
    now, value, gaining = _looked(near, state, m2)
    r, part = 0, 2
    while gaining:
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(part)) == 0
        moved = now.select("node", F.coalesce(F.when(turn, F.col("to")), F.col("block")).alias("block"), "d", "parts")
        new, got, left = _looked(near, moved, m2)
        r += 1
        if got > value + least:
            now, value, gaining, part = new, got, left, max(1, part // 2)
        elif part > 16:
            break
        else:
            part *= 2
    return now


def louvain(edges: DataFrame, least: float = 1e-3) -> DataFrame:
    """``node, block``: communities by levels of modularity, each named by its smallest node.

    A level moves nodes between blocks as long as modularity rises by ``least`` a round, then contracts each block to a node whose loop
    holds its inner edges. Levels end when one moves nothing, so modularity never falls. The graph is undirected and simple.
    """
    from gneiss.operators import parts

    near = written(neighbours(edges))
    m2 = float(near.count())
    of = None
    if not m2:
        return near.select(F.col("src").alias("node"), F.col("src").alias("block"))

    def contracted(part, ends: pa.Table, own: pa.Array) -> pa.Table:
        names, of = np.unique(ends.column("name").to_numpy(), return_inverse=True)
        cell, at = np.unique(of[part.rows][part.src] * len(names) + of[part.at], return_inverse=True)
        return pa.table({"src": names[cell // len(names)], "dst": names[cell % len(names)], "w": np.bincount(at, part.w)})

    while True:
        graph = parts.packed(near)
        now = _moved(graph, written(parts.states(graph).select("node", F.col("node").alias("block"), "d", "parts")), m2, least)
        names = now.groupBy("block").agg(F.min("node").alias("name"))
        level = written(now.join(names.hint("merge"), "block").select("node", F.col("name").alias("block"), "parts"))
        up = level.select(F.col("node").alias("block"), F.col("block").alias("_up"))
        of = level.select("node", "block") if of is None else written(of.join(up.hint("merge"), "block").select("node", F.col("_up").alias("block")))
        if level.where("node <> block").isEmpty():
            return of
        cells = parts.visited(graph, level, [F.col("block").alias("name")], [], contracted, "src long, dst long, w double")
        near = written(cells.groupBy("src", "dst").agg(F.sum("w").alias("w")))


def spectral(edges: DataFrame, k: int, how: str = "normalized", seed: int = 0, least: float = 1e-3) -> DataFrame:
    """``node, block``: k-means on the ``k`` leading eigenvectors of the graph, rows scaled to length 1, from :mod:`gneiss.operators.spectra`; its rounds end when no eigenvalue moves by ``least``."""
    from gneiss.operators import spectra

    vectors, _ = spectra.eigenvectors(edges, k, how, least=least)
    return spectra.clustered(vectors, k, seed)


def same_group_pairs(partition: DataFrame, size: int = 1024) -> DataFrame:
    """Pairs ``a < b`` in one block. Blocks are dealt in parts of about ``size`` nodes, of which each two meet once, so no task has a whole block's pairs."""
    parts = partition.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    # Cells hold much work for few bytes, so their number, not their size, makes the tasks.
    tasks = min(2000, int(parts.agg(F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2)).first()[0] or 1))
    keys = ["block", "_p", "_q"]
    dealt = partition.join(parts, "block").select("node", "block", "_n", F.pmod(F.xxhash64("node"), "_n").cast("int").alias("_p"))
    a = dealt.select(F.col("node").alias("a"), "block", "_p", F.explode(F.sequence(F.col("_p"), F.col("_n") - 1)).alias("_q"))
    b = dealt.select(F.col("node").alias("b"), "block", F.col("_p").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_p"))
    met = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys).hint("merge"), keys).where((F.col("a") < F.col("b")) | ((F.col("_p") < F.col("_q")) & (F.col("a") > F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def treatment(edges: DataFrame, method: str, k: int = 2, seed: int = 0) -> DataFrame:
    """Treated pairs ``a < b`` by one of: kcore, anchor_nodes, common_neighbors, jaccard, katz, propagation, louvain, spectral, components, sbm.

    ``sbm`` infers ``k`` blocks: a random partition, improved by moves that gain score until none does.
    """
    from gneiss.operators.blocks import em_partition, random_partition

    blocks = {
        "kcore": lambda: kcore(edges).where("core > 0").select("node", F.col("core").alias("block")),
        "anchor_nodes": lambda: anchor_ball(edges, k).select("node", F.lit(0).alias("block")),
        "propagation": lambda: label_propagation(edges, k),
        "louvain": lambda: louvain(edges),
        "spectral": lambda: spectral(edges, k),
        "components": lambda: components(edges).select("node", F.col("component").alias("block")),
        "sbm": lambda: em_partition(edges, random_partition(nodes_of(edges), k, seed)),
    }
    if method in blocks:
        return same_group_pairs(blocks[method]())
    if method == "common_neighbors":
        return wedge_counts(edges, k).select("a", "b")
    if method == "jaccard":
        return jaccard(edges, 0.5).select("a", "b")
    if method == "katz":
        return katz_treatment(edges, k).select("a", "b")
    raise ValueError(f"unknown treatment: {method}")


def knn_in_blocks(vectors: DataFrame, block: str, k: int, how: str = "euclid") -> DataFrame:
    """``a, rank, b, distance``: nearest of a node in its block; blocks (hash tables, labels) bound what is compared."""
    a, b = (vectors.select(F.col("node").alias(n), F.col(block).alias("_b"), F.col("v").alias(f"v{n}")) for n in ("a", "b"))
    met = a.join(b, "_b").where("a <> b").select("a", "b", distance(F.col("va"), F.col("vb"), how).alias("distance"))
    w = Window.partitionBy("a").orderBy("distance", "b")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "rank", "b", "distance")


def factual_pairs(treated: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b`` for each treated pair once, ``a < b``; ``n_treated`` and ``n_untreated`` count both sides of all pairs.

    The untreated side is the complement: pairs of different nodes that aren't here. It isn't listed, as it grows with the square.
    """
    pairs = treated.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    n, m = nodes.select("node").distinct().count(), pairs.count()
    return pairs.select("a", "b", F.lit(m).cast("long").alias("n_treated"), F.lit(n * (n - 1) // 2 - m).cast("long").alias("n_untreated"))


def same_group_factual_pairs(partition: DataFrame) -> DataFrame:
    """:func:`factual_pairs` of all pairs in one block of ``partition(node, block)``; where each node is in one block no pair comes twice, so they are counted by block and not shuffled."""
    held = written(partition.select("node", "block").distinct(), "partition")
    if not held.groupBy("node").count().where("count > 1").isEmpty():
        return factual_pairs(same_group_pairs(held), held)
    size = held.where("node is not null and block is not null").groupBy("block").agg(F.count("*").alias("n"))
    n, m = held.count(), size.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    return same_group_pairs(held).select("a", "b", F.lit(m).cast("long").alias("n_treated"), F.lit(n * (n - 1) // 2 - m).cast("long").alias("n_untreated"))


def counterfactual_edges(matched: DataFrame, treated: DataFrame) -> DataFrame:
    """``t, c, d``: the different pairs that stand in for others, ``c < d``, by their own treatment, from :func:`counterfactual_pairs`."""
    flag = treated.select(F.least("a", "b").alias("c"), F.greatest("a", "b").alias("d")).distinct().withColumn("_t", F.lit(1))
    pairs = matched.where("matched").select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()
    return pairs.join(flag, ["c", "d"], "left").select(F.coalesce("_t", F.lit(0)).alias("t"), "c", "d")


def counterfactual_pairs(pairs: DataFrame, treated: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """``a, b, c, d``: for each pair the nearest pair of near nodes with the opposite treatment, within twice the threshold; else itself.

    ``near(a, b, distance)`` holds each node's nearest, itself at 0 included; ``treated(a, b)`` has both orders. What isn't in ``near``
    isn't looked at: :func:`gneiss.operators.nearest.counterfactual_matches` finds the nearest of all pairs.
    """
    flag = treated.select("a", "b").distinct().withColumn("_t", F.lit(1))
    t = pairs.join(flag, ["a", "b"], "left").fillna(0, ["_t"])
    left, right = near.select("a", F.col("b").alias("c"), F.col("distance").alias("_x")), near.select(F.col("a").alias("b"), F.col("b").alias("d"), F.col("distance").alias("_y"))
    met = t.join(left, "a").join(right, "b").where((F.col("c") != F.col("d")) & (F.col("_x") + F.col("_y") <= 2 * threshold))
    other = met.join(flag.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("_t").alias("_u")), ["c", "d"], "left").fillna(0, ["_u"]).where("_u <> _t")
    best = other.groupBy("a", "b").agg(F.min(F.struct((F.col("_x") + F.col("_y")).alias("s"), "c", "d")).alias("x"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", F.coalesce("x.c", "a").alias("c"), F.coalesce("x.d", "b").alias("d"), F.col("x").isNotNull().alias("matched"))


def score_links(pairs: DataFrame, vectors: DataFrame, how: str = "dot", matrix: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """``a, b, score`` by inner product, ``bilinear`` with a matrix between, ``symmetric`` (the mean of that in both orders), or the elementwise product as a vector (``hadamard``)."""
    met = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    if how == "hadamard":
        return met.select("a", "b", F.zip_with("va", "vb", lambda x, y: x * y).alias("score"))
    if how in ("bilinear", "symmetric"):
        rows = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in matrix))
        through = lambda x, y: dot(x, F.transform(rows, lambda row: dot(row, y)))
        one = through(F.col("va"), F.col("vb"))
        return met.select("a", "b", (one if how == "bilinear" else (one + through(F.col("vb"), F.col("va"))) / 2).alias("score"))
    return met.select("a", "b", dot(F.col("va"), F.col("vb")).alias("score"))


def common_neighbors(edges: DataFrame, k: int, hops: int = 3) -> DataFrame:
    """``a, b, common``: pairs that share at least ``k`` nodes of what each reaches in 1 to ``hops`` steps, itself included where a walk returns; in a dense graph strip by strip."""
    near = written(neighbours(edges))
    if hops > 1 and strips.is_dense(near):
        return strips.common_reached(near, k, hops)
    near = _sets(near)
    reach = step = near
    for _ in range(hops - 1):
        step = written(products(step, near).select(F.col("a").alias("node"), F.col("b").alias("item")))
        reach = reach.union(step)
    pairs = products(reach.distinct(), keep=lambda da, db, n: n >= k)
    return pairs.select("a", "b", F.col("value").cast("long").alias("common"))
