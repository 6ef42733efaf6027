"""Block-model statistics and scores for edges ``(src, dst, w)`` and a partition ``(node, block)``.

Undirected counts are symmetric with the diagonal counted twice. Tables of blocks are aggregates of the edges; scores
are sums over them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.mathx import log_factorial, xlogx
from gneiss.plans.rank import hash_order, with_index
from gneiss.plans.store import written


def random_partition(nodes: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """The first ``blocks`` nodes in hash order take a block each, the others a hashed one, so none is empty."""
    ranked = with_index(nodes.select("node").withColumn("_h", hash_order(seed, "node")), "_h", "node", name="_i")
    other = F.conv(F.substring(F.col("_h"), 1, 8), 16, 10).cast("long") % blocks
    return ranked.select("node", F.when(F.col("_i") < blocks, F.col("_i")).otherwise(other).cast("int").alias("block"))


def _placed(edges: DataFrame, part: DataFrame) -> DataFrame:
    return edges.join(part.select(F.col("node").alias("src"), F.col("block").alias("r")), "src").join(part.select(F.col("node").alias("dst"), F.col("block").alias("s")), "dst")


def block_edges(edges: DataFrame, part: DataFrame, directed: bool = False) -> DataFrame:
    """``r, s, e``."""
    counts = _placed(edges, part).groupBy("r", "s").agg(F.sum("w").alias("e"))
    if directed:
        return counts
    return counts.unionByName(counts.select(F.col("s").alias("r"), F.col("r").alias("s"), "e")).groupBy("r", "s").agg(F.sum("e").alias("e"))


def block_stats(edges: DataFrame, part: DataFrame) -> DataFrame:
    """``block, size, out_degree, in_degree, degree`` with weighted degrees."""
    met = _placed(edges, part)
    out, in_ = met.groupBy(F.col("r").alias("block")).agg(F.sum("w").alias("out_degree")), met.groupBy(F.col("s").alias("block")).agg(F.sum("w").alias("in_degree"))
    sizes = part.groupBy("block").agg(F.count("*").alias("size"))
    all_ = sizes.join(out, "block", "left").join(in_, "block", "left").fillna(0, ["out_degree", "in_degree"])
    return all_.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def block_degree_dist(edges: DataFrame, part: DataFrame) -> DataFrame:
    """``block, degree, n, share`` of nodes by the number of their edge ends."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    counts = part.join(degree, "node", "left").fillna(0, ["degree"]).groupBy("block", "degree").agg(F.count("*").alias("n"))
    return counts.join(part.groupBy("block").agg(F.count("*").alias("_all")), "block").select("block", "degree", "n", (F.col("n") / F.col("_all")).alias("share"))


def block_joint_degrees(edges: DataFrame, part: DataFrame) -> DataFrame:
    """``block, in_degree, out_degree, n, share`` of nodes by both their degrees; nodes without edges have 0 and 0."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = edges.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    counts = part.join(degree, "node", "left").fillna(0, ["in_degree", "out_degree"]).groupBy("block", "in_degree", "out_degree").agg(F.count("*").alias("n"))
    return counts.join(part.groupBy("block").agg(F.count("*").alias("_all")), "block").select("block", "in_degree", "out_degree", "n", (F.col("n") / F.col("_all")).alias("share"))


def node_block_edges(edges: DataFrame, part: DataFrame) -> DataFrame:
    """``node, block, k``: weight of a node's edges to each block, loops apart."""
    ends = edges.where("src <> dst")
    both = ends.select(F.col("src").alias("node"), F.col("dst").alias("o"), "w").unionByName(ends.select(F.col("dst").alias("node"), F.col("src").alias("o"), "w"))
    return both.join(part.select(F.col("node").alias("o"), "block"), "o").groupBy("node", "block").agg(F.sum("w").alias("k"))


def block_covariates(edges: DataFrame, part: DataFrame, covariate: str, directed: bool = False) -> DataFrame:
    """``r, s, total``: sums of an edge's covariate over each pair of blocks."""
    return block_edges(edges.withColumn("w", F.col(covariate)), part, directed).withColumnRenamed("e", "total")


def merge_blocks(part: DataFrame, mapping: DataFrame) -> DataFrame:
    return part.join(mapping.select("block", "into"), "block", "left").select("node", F.coalesce("into", "block").alias("block"))


def block_rollup(edges: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``level, r, s, e`` for a partition of the nodes and partitions of the blocks below."""
    out, now = None, edges
    for k, part in enumerate(levels):
        e = block_edges(now, part, directed=True)
        tagged = e.select(F.lit(k).alias("level"), "r", "s", "e")
        out = tagged if out is None else out.unionByName(tagged)
        now = e.select(F.col("r").alias("src"), F.col("s").alias("dst"), F.col("e").alias("w"))
    return out


def compose_levels(low: DataFrame, high: DataFrame) -> DataFrame:
    return low.join(high.select(F.col("node").alias("block"), F.col("block").alias("_up")), "block").select("node", F.col("_up").alias("block"))


def _cells(edges: DataFrame, part: DataFrame, directed: bool) -> DataFrame:
    e, b = block_edges(edges, part, directed), block_stats(edges, part)
    side = lambda n: b.select(F.col("block").alias(n), F.col("size").alias(f"n_{n}"), F.col("out_degree").alias(f"o_{n}"), F.col("in_degree").alias(f"i_{n}"), F.col("degree").alias(f"k_{n}"))
    return e.join(side("r"), "r").join(side("s"), "s")


def score(edges: DataFrame, part: DataFrame, name: str, directed: bool = False) -> DataFrame:
    """One row ``score`` for SKN, DCKN, SPS, SPD or DCP."""
    name = name.upper()
    e = F.col("e").cast("double")
    if name == "SKN":
        return _cells(edges, part, directed).agg(F.sum(e * F.log(e / (F.col("n_r") * F.col("n_s")))).alias("score"))
    if name in ("DCKN", "DCP"):
        ends = F.col("o_r") * F.col("i_s") if directed else F.col("k_r") * F.col("k_s")
        dckn = _cells(edges, part, directed).agg(F.sum(e * F.log(e / ends)).alias("score"))
        if name == "DCKN":
            return dckn
        m = edges.agg(F.sum("w")).first()[0]
        degree = edges.select(F.explode(F.array("src", "dst")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k"))
        fixed = -m - (degree.agg(F.sum(log_factorial(F.col("k")))).first()[0] or 0.0)
        return dckn.select((-(F.lit(fixed) - F.col("score") / 2)).alias("score"))
    if name == "SPS":
        m = edges.agg(F.sum("w")).first()[0]
        inner = block_edges(edges, part, directed).agg(F.sum(xlogx(e)).alias("x"))
        outer = block_stats(edges, part).agg(F.sum(F.col("degree") * F.log("size")).alias("y"))
        return inner.join(F.broadcast(outer)).select((-(m + F.col("y") - (1.0 if directed else 0.5) * F.col("x"))).alias("score"))
    if name == "SPD":
        cells = _cells(edges, part, directed)
        p = e / (F.col("n_r") * F.col("n_s"))
        entropy = -(F.when(p > 0, p * F.log2(p)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log2(1 - p)).otherwise(0.0))
        return cells.agg((-F.sum(e * F.when((p > 0) & (p < 1), entropy).otherwise(0.0)) * (1.0 if directed else 0.5)).alias("score"))
    raise ValueError(f"unknown score: {name}")


def penalty(name: str, n: int, m: float, blocks: int, directed: bool = False, corrected: bool = False) -> float:
    """What a criterion takes off a score for ``blocks`` blocks on ``n`` nodes and ``m`` edges.

    AIC, BIC (``n**2`` places for edges), BIC_SPARSE (``n**3``), ICL (without degree correction only), MDL_FIRST and
    MDL_TRADITIONAL. MDL needs the partition: see ``likelihoods.description_length``.
    """
    cells = blocks * blocks if directed else blocks * (blocks + 1) / 2
    h = lambda x: (1 + x) * math.log(1 + x) - x * math.log(x)
    places = n * n if directed else n * (n - 1) / 2
    made = {
        "AIC": lambda: cells + blocks + (blocks if corrected else 0),
        "BIC": lambda: cells * math.log(n),
        "BIC_SPARSE": lambda: 1.5 * cells * math.log(n),
        "ICL": lambda: (blocks - 1) / 2 * math.log(n) + cells / 2 * math.log(places),
        "MDL_FIRST": lambda: m * h(cells / m) + n * math.log(blocks),
        "MDL_TRADITIONAL": lambda: m * math.log(blocks) + cells * math.log(m),
    }
    if name.upper() not in made or name.upper() == "ICL" and corrected:
        raise ValueError(f"unknown penalty: {name}{' with degree correction' if corrected else ''}")
    return made[name.upper()]()


_CRITERIA = ("AIC", "MDL", "BIC_SPARSE", "BIC", "MDL_TRADITIONAL", "MDL_FIRST")
#: Which penalties suit which score; the integrated likelihoods need none.
PENALTIES = {
    **dict.fromkeys(("SKN", "SPS", "SPD"), ("ICL", *_CRITERIA)),
    **dict.fromkeys(("DCKN", "DCP"), _CRITERIA),
    **dict.fromkeys(("ICL_J", "ICL_U", "NR", "NR_DC", "FLAT", "FLAT_UNIFORM", "FLAT_HYPERPRIOR"), ()),
}


def select_blocks(scores: DataFrame, n: int, m: float, name: str, directed: bool = False, corrected: bool = False, costs: dict[int, float] | None = None) -> DataFrame:
    """``blocks, value``: the number of blocks with the largest score less penalty, from ``scores(blocks, score)``; ``costs`` by number of blocks replace a named penalty."""
    counts = [r["blocks"] for r in scores.select("blocks").distinct().collect()]  # a row for each number of blocks tried
    cost = F.create_map(*(F.lit(x) for b in counts for x in (b, float(costs[b] if costs is not None else penalty(name, n, m, b, directed, corrected)))))
    value = F.col("score") - cost[F.col("blocks")]
    return scores.select("blocks", value.alias("value")).agg(F.max_by("blocks", F.struct("value", -F.col("blocks"))).alias("blocks"), F.max("value").alias("value"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """``h1, h2, mi, nmi`` of two partitions of the same nodes; 0 if either has one block."""
    both = a.select("node", F.col("block").alias("x")).join(b.select("node", F.col("block").alias("y")), "node").groupBy("x", "y").agg(F.count("*").alias("c"))
    both = written(both)
    n = both.agg(F.sum("c")).first()[0]
    entropy = lambda col, name: both.groupBy(col).agg(F.sum("c").alias("c")).agg((-F.sum(F.col("c") / n * F.log(F.col("c") / n))).alias(name))
    joint = both.agg((-F.sum(F.col("c") / n * F.log(F.col("c") / n))).alias("h12"))
    row = entropy("x", "h1").join(F.broadcast(entropy("y", "h2"))).join(F.broadcast(joint))
    mi = F.col("h1") + F.col("h2") - F.col("h12")
    return row.select("h1", "h2", mi.alias("mi"), F.when((F.col("h1") > 1e-12) & (F.col("h2") > 1e-12), mi / F.sqrt(F.col("h1") * F.col("h2"))).otherwise(0.0).alias("nmi"))


def em_partition(edges: DataFrame, part: DataFrame, rounds: int | None = None, name: str = "DCKN", least: float = 0.001) -> DataFrame:
    """``node, block`` by synchronous rounds: each node takes the block with the largest gain of the score ``name``, if that is over ``least``.

    Gains are those of :func:`move_gains`, of moves one at a time. Moves made together can undo each other, so a round counts only if
    the score of all rises; else half of its moves are made, by a hash, then a quarter, and in the end the single best one, which
    rises by its gain. Rounds end when no move gains. A node that is alone in its block stays, and the smallest of a block's nodes stays if all would
    leave, so no block is lost.
    """
    edges, now = written(edges.select("src", "dst", "w"), "edges"), written(part.select("node", "block"))
    value = score(edges, now, name).first()[0]
    done = 0
    while rounds is None or done < rounds:
        best = move_gains(edges, now, name).where(F.col("gain") > least).groupBy("node").agg(F.max_by("block", F.struct("gain", -F.col("block"))).alias("to"), F.max("gain").alias("gain"))
        met = now.join(best, "node", "left")
        leaves = met.groupBy("block").agg(F.count("*").alias("n"), F.count("to").alias("m"), F.min("node").alias("_stays"))
        able = met.where("to is not null").join(leaves, "block").where("n > 1 and not (n = m and node = _stays)").select("node", "to", "gain")
        able = written(able)
        if able.isEmpty():
            return now
        share = 1
        while True:
            turn = F.pmod(F.xxhash64("node", F.lit(done)), F.lit(share)) == 0
            if share > 64:
                one = able.agg(F.max_by(F.struct("node", "to"), F.struct("gain", -F.col("node"))).alias("m")).first()["m"]
                turn = F.col("node") == one["node"]
            new = written(now.join(able.where(turn).select("node", "to"), "node", "left").select("node", F.coalesce("to", "block").alias("block")))
            got = score(edges, new, name).first()[0]
            if got > value:
                now, value = new, got
                break
            if share > 64:
                return now
            share *= 2
        done += 1
    return now


def ami(a: DataFrame, b: DataFrame) -> DataFrame:
    """``mi, expected, ami``: mutual information less its expectation under random partitions of the same sizes, over the mean entropy less that."""
    info = written(nmi(a, b))
    n = a.count()
    sizes = lambda df, c: df.groupBy("block").agg(F.count("*").cast("long").alias(c)).groupBy(c).agg(F.count("*").alias(f"times_{c}")).withColumn("_one", F.lit(1))
    # Pairs of block sizes, not of blocks: equal sizes have equal terms.
    pairs = sizes(a, "x").join(sizes(b, "y"), "_one")
    low = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - n)
    terms = pairs.withColumn("c", F.explode(F.sequence(low, F.least("x", "y"))))
    f = lambda e: log_factorial(e)
    total = F.lit(n)
    weight = f(F.col("x")) + f(F.col("y")) + f(total - F.col("x")) + f(total - F.col("y")) - f(total) - f(F.col("c")) - f(F.col("x") - F.col("c")) - f(F.col("y") - F.col("c")) - f(total - F.col("x") - F.col("y") + F.col("c"))
    share = F.col("c") / total
    expected = terms.agg(F.sum(F.col("times_x") * F.col("times_y") * share * F.log(total * F.col("c") / (F.col("x") * F.col("y"))) * F.exp(weight)).alias("expected"))
    return info.join(F.broadcast(expected)).select("mi", "expected", ((F.col("mi") - F.col("expected")) / F.nullif((F.col("h1") + F.col("h2")) / 2 - F.col("expected"), F.lit(0.0))).alias("ami"))


def nmi_baseline(truth: DataFrame, blocks: int, draws: int, seed: int = 0) -> DataFrame:
    """``draw, nmi`` of random partitions with the truth."""
    out = None
    for k in range(draws):
        one = nmi(truth, random_partition(truth, blocks, seed + k)).select(F.lit(k).alias("draw"), "nmi")
        out = one if out is None else out.unionByName(one)
    return out


def summarize_runs(runs: DataFrame) -> DataFrame:
    """Best run by value and mean for each (test, inference), each test, and all, from ``runs(test, inference, run, value)``."""
    return runs.rollup("test", "inference").agg(F.max_by("run", F.struct("value", -F.col("run"))).alias("best_run"), F.max("value").alias("best"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def scores_by_blocks(edges: DataFrame, parts: dict[int, DataFrame], name: str) -> DataFrame:
    """``blocks, score`` of each partition, and of one block always."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = score(edges, nodes.select("node", F.lit(0).alias("block")), name).select(F.lit(1).alias("blocks"), "score")
    for b, part in parts.items():
        out = out.unionByName(score(edges, part, name).select(F.lit(b).alias("blocks"), "score"))
    return out


def _dense_cell(e: Column, places: Column) -> Column:
    """What a pair of blocks with ``e`` edge ends in ``places`` adds to twice the score SPD."""
    p = e / F.nullif(places, F.lit(0))
    entropy = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((e > 0) & (p < 1), -e * entropy).otherwise(0.0)


def move_gains(edges: DataFrame, part: DataFrame, name: str = "DCKN", blocks: Sequence[int] | None = None) -> DataFrame:
    """``node, block, gain``: change of the undirected score ``name`` when a node moves to each block it has edges to, or to each of ``blocks``.

    SKN, DCKN, SPS and DCP are sums of ``x log x`` of the counts of pairs of blocks, and of a term of each block's size or degree. So
    a move changes those of its two blocks, and of pairs of one of these with blocks that the node has edges to. SPD also divides by
    sizes: what all pairs of a block change by when it grows or shrinks by a node is summed for each block once, and corrected where the
    node has edges. A loop moves with its node. A node that is alone in its block may leave it. Nodes of ``edges`` have a block.
    """
    name = name.upper()
    k = written(node_block_edges(edges, part))
    # Both ends of an edge are in k, so the counts of pairs of blocks are sums of it, and of loops twice.
    inner = edges.where("src = dst").select(F.col("src").alias("node"), (2 * F.col("w")).alias("k")).join(part, "node").select("node", "block", "k")
    ends = k.select("node", "block", "k").unionByName(inner).join(part.select("node", F.col("block").alias("r")), "node")
    e = written(ends.groupBy("r", F.col("block").alias("s")).agg(F.sum("k").alias("e")))
    loops = edges.where("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("l"))
    nodes = part.join(k.groupBy("node").agg(F.sum("k").alias("d")), "node", "left").join(loops, "node", "left").fillna(0, ["d", "l"])
    nodes = written(nodes.select("node", F.col("block").alias("of"), "l", (F.col("d") + 2 * F.col("l")).alias("d")))
    stats = written(part.groupBy("block").agg(F.count("*").alias("n")).join(e.groupBy(F.col("r").alias("block")).agg(F.sum("e").alias("kr")), "block", "left").fillna(0, ["kr"]))
    if blocks is None:
        moves = k.select("node", F.col("block").alias("to")).join(nodes, "node").where("to <> of")
    else:
        moves = nodes.withColumn("to", F.explode(F.array(*(F.lit(b) for b in blocks)))).where("to <> of")
    moves = moves.join(stats.select(F.col("block").alias("of"), F.col("n").alias("no"), F.col("kr").alias("dr")), "of")
    moves = moves.join(stats.select(F.col("block").alias("to"), F.col("n").alias("nt"), F.col("kr").alias("ds")), "to", "left").fillna(0, ["nt", "ds"])
    count = lambda x, y, c: e.select(F.col("r").alias(x), F.col("s").alias(y), F.col("e").alias(c))
    own = lambda c, value: k.select("node", F.col("block").alias(c), F.col("k").alias(value))
    c = F.col
    two = moves.join(own("of", "ko"), ["node", "of"], "left").join(own("to", "kn"), ["node", "to"], "left")
    two = two.join(count("of", "of2", "rr").where("of = of2").drop("of2"), "of", "left").join(count("to", "to2", "ss").where("to = to2").drop("to2"), "to", "left").join(count("of", "to", "rs"), ["of", "to"], "left").fillna(0, ["ko", "kn", "rr", "ss", "rs"])
    touched = moves.join(k.select("node", c("block").alias("t"), c("k").alias("kt")), "node").where("t <> to and t <> of").join(count("of", "t", "a"), ["of", "t"], "left").join(count("to", "t", "b"), ["to", "t"], "left").fillna(0, ["a", "b"])
    rr, ss, rs = c("rr") - 2 * c("ko") - 2 * c("l"), c("ss") + 2 * c("kn") + 2 * c("l"), c("rs") + c("ko") - c("kn")
    if name == "SPD":
        sized = e.join(stats.select(c("block").alias("r"), c("n").alias("nr")), "r").join(stats.select(c("block").alias("s"), c("n").alias("ns")), "s").where("r <> s")
        cell = _dense_cell
        change = lambda by: F.sum(cell(c("e"), (c("nr") + by) * c("ns")) - cell(c("e"), c("nr") * c("ns")))
        base = written(sized.groupBy(c("r").alias("block")).agg(change(-1).alias("less"), change(1).alias("more")))
        third = touched.join(stats.select(c("block").alias("t"), c("n").alias("m")), "t")
        # Beside the sums for whole blocks: cells that the node has edges to.
        less, more = (c("no") - 1) * c("m"), (c("nt") + 1) * c("m")
        outer = third.groupBy("node", "to").agg(F.sum(2 * (cell(c("a") - c("kt"), less) - cell(c("a"), less) + cell(c("b") + c("kt"), more) - cell(c("b"), more))).alias("x"))
        met = two.join(base.select(c("block").alias("of"), "less"), "of", "left").join(base.select(c("block").alias("to"), "more"), "to", "left").fillna(0.0, ["less", "more"])
        no, nt = c("no"), c("nt")
        # The cell of the two blocks is in both sums, with one size changed; it is taken out of them and counted with both.
        both = 2 * (cell(rs, (no - 1) * (nt + 1)) - cell(c("rs"), no * nt)) - 2 * (cell(c("rs"), (no - 1) * nt) - cell(c("rs"), no * nt)) - 2 * (cell(c("rs"), no * (nt + 1)) - cell(c("rs"), no * nt))
        inner = cell(rr, (no - 1) * (no - 1)) - cell(c("rr"), no * no) + cell(ss, (nt + 1) * (nt + 1)) - cell(c("ss"), nt * nt)
        gain = (inner + both + 2 * (c("less") + c("more")) + F.coalesce("x", F.lit(0.0))) / 2
        return met.join(outer, ["node", "to"], "left").select("node", c("to").alias("block"), gain.alias("gain"))
    outer = touched.groupBy("node", "to").agg(F.sum(2 * (xlogx(c("a") - c("kt")) - xlogx(c("a")) + xlogx(c("b") + c("kt")) - xlogx(c("b")))).alias("x"))
    inner = xlogx(rr) - xlogx(c("rr")) + xlogx(ss) - xlogx(c("ss")) + 2 * (xlogx(rs) - xlogx(c("rs")))
    if name in ("DCKN", "DCP"):
        sizes = -2 * (xlogx(c("dr") - c("d")) - xlogx(c("dr")) + xlogx(c("ds") + c("d")) - xlogx(c("ds")))
    elif name in ("SKN", "SPS"):
        of_size = lambda degree, n: F.when(n > 0, degree * F.log(F.greatest(n, F.lit(1)))).otherwise(0.0)
        sizes = -2 * (of_size(c("dr") - c("d"), c("no") - 1) - of_size(c("dr"), c("no")) + of_size(c("ds") + c("d"), c("nt") + 1) - of_size(c("ds"), c("nt")))
    else:
        raise ValueError(f"unknown score: {name}")
    half = 0.5 if name in ("SPS", "DCP") else 1.0
    return two.join(outer, ["node", "to"], "left").select("node", c("to").alias("block"), ((inner + sizes + F.coalesce("x", F.lit(0.0))) * half).alias("gain"))
