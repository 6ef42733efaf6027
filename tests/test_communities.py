"""Communities by levels, moves by gain, similar sets and samples, each against its definition."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import blocks, explain, graphs, sampling, splits
from gneiss.plans.rank import first_by_hash


def frame(spark, pairs, w=None):
    return spark.createDataFrame([(a, b, 1 if w is None else w[i]) for i, (a, b) in enumerate(pairs)], "src long, dst long, w long")


def planted(sizes, inside, outside, seed):
    rng, of = random.Random(seed), [b for b, n in enumerate(sizes) for _ in range(n)]
    return of, [(i, j) for i in range(len(of)) for j in range(i) if rng.random() < (inside if of[i] == of[j] else outside)]


def test_louvain_finds_planted_blocks_over_levels(spark):
    """Rings of cliques need several levels; modularity is no lower than after one level."""
    of, pairs = planted([12, 12, 12, 12], 0.8, 0.03, 1)
    df = frame(spark, pairs)
    got = graphs.louvain(df)
    assert blocks.nmi(got, spark.createDataFrame(list(enumerate(of)), "node long, block long")).first().nmi > 0.95
    ring = [(5 * c + i, 5 * c + j) for c in range(12) for i in range(5) for j in range(i)] + [(5 * c, 5 * ((c + 1) % 12) + 1) for c in range(12)]
    df = frame(spark, ring)
    got = {r.node: r.block for r in graphs.louvain(df).collect()}
    assert all(got[5 * c] == got[5 * c + i] for c in range(12) for i in range(5))
    value = graphs.modularity(df, graphs.louvain(df)).first().modularity
    assert value >= graphs.modularity(df, spark.createDataFrame([(n, n // 5) for n in range(60)], "node long, block long")).first().modularity - 1e-9
    assert graphs.louvain(df.limit(0)).count() == 0
    assert {r.block for r in graphs.louvain(frame(spark, [(1, 2), (5, 6)])).collect()} == {1, 5}


@pytest.mark.parametrize("name", ["SKN", "DCKN", "SPS", "SPD", "DCP"])
def test_gains_are_differences_of_scores(spark, name):
    """All nodes and blocks of a small weighted graph with loops, one node alone in its block."""
    rng = random.Random(5)
    pairs = [(i, j) for i in range(9) for j in range(i) if rng.random() < 0.5] + [(3, 3), (4, 4)]
    df = frame(spark, pairs, [rng.choice([1, 2, 5]) for _ in pairs])
    of = {n: n % 3 if n < 8 else 3 for n in range(9)}
    part = spark.createDataFrame(list(of.items()), "node long, block long")
    before = blocks.score(df, part, name).first().score
    got = {(r.node, r.block): r.gain for r in blocks.move_gains(df, part, name, blocks=[0, 1, 2, 3]).collect()}
    assert set(got) == {(n, b) for n in of for b in range(4) if b != of[n]}
    moved = None
    for n, b in sorted(got)[:: 3 if name != "SPD" else 2]:
        one = blocks.score(df, part.withColumn("block", F.when(F.col("node") == n, b).otherwise(F.col("block"))), name).select(F.lit(n).alias("node"), F.lit(b).alias("block"), "score")
        moved = one if moved is None else moved.unionByName(one)
    for r in moved.collect():
        assert abs(r.score - before - got[r.node, r.block]) < 1e-6, (r, got[r.node, r.block])
    some = blocks.move_gains(df, part, name).collect()
    assert some and all(abs(got[r.node, r.block] - r.gain) < 1e-9 for r in some)


def test_moves_by_gain_never_lower_the_score(spark):
    of, pairs = planted([10, 10, 10], 0.8, 0.05, 2)
    df, truth = frame(spark, pairs), spark.createDataFrame(list(enumerate(of)), "node long, block long")
    rng = random.Random(1)
    start = spark.createDataFrame([(n, b if rng.random() < 0.75 else rng.randrange(3)) for n, b in enumerate(of)], "node long, block long")
    seen = [blocks.score(df, start, "DCKN").first().score]
    now = start
    for _ in range(3):
        now = blocks.em_partition(df, now, 1)
        seen.append(blocks.score(df, now, "DCKN").first().score)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    end = blocks.em_partition(df, start)
    assert blocks.nmi(end, truth).first().nmi > 0.95 and end.select("block").distinct().count() == 3
    assert blocks.move_gains(df, end).where("gain > 0.001").join(end.groupBy("block").count().where("count > 1"), "block", "left_semi").count() == 0


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_similar_neighbourhoods(spark, least):
    rng = random.Random(8)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(400)) if a != b} | {(0, n) for n in range(1, 60)} | {(n, m) for n in (70, 71, 72) for m in (1, 2, 3)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b) for a in near for b in near if a < b and len(near[a] & near[b]) >= least * len(near[a] | near[b])}
    got = graphs.jaccard_join(frame(spark, sorted(pairs)), least).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and want
    assert all(abs(r.similarity - len(near[r.a] & near[r.b]) / len(near[r.a] | near[r.b])) < 1e-12 for r in got)


def test_first_rows_by_hash(spark):
    """The same rows as a sort of all, at every number, with few and many leading digits; no task takes the first n."""
    df = spark.range(3000).selectExpr("id", "id % 7 as x")
    import hashlib

    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    for n, digits in ((0, 2), (1, 5), (17, 1), (1500, 2), (2999, 3), (3000, 5), (9999, 1)):
        assert sorted(r.id for r in first_by_hash(df, n, 3, "id", digits=digits).collect()) == sorted(order[:n])
    plan = first_by_hash(df, 1500, 3, "id")._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert first_by_hash(df.limit(0), 5, 3, "id").count() == 0
    again = df.unionByName(df).where("id < 10")
    assert first_by_hash(again, 7, 3, "id").count() == 7


def test_non_edges_follow_one_rule(spark):
    """What is drawn for few is the beginning of what is drawn for many, until all are there; nodes of edges outside don't count."""
    edges = frame(spark, [(i, (7 * i + 3) % 50) for i in range(50)] + [(900, 901)])
    nodes = spark.range(50).select(F.col("id").alias("node"))
    few, many, every = ([(r.src, r.dst) for r in splits.numbered_non_edges(edges, nodes, n, 2).orderBy("place").collect()] for n in (5, 300, 10_000))
    taken = {(min(i, (7 * i + 3) % 50), max(i, (7 * i + 3) % 50)) for i in range(50)}
    assert few == many[:5] and many == every[:300] and set(every) == {(i, j) for i in range(50) for j in range(i + 1, 50)} - taken and len(every) == len(set(every))
    assert splits.numbered_non_edges(edges, nodes.limit(1), 3).count() == 0 and splits.numbered_non_edges(edges.limit(0), nodes.limit(2), 3).count() == 1
    assert sampling.sample_pairs(nodes.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")), nodes.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")), 7).count() == 7


def test_parts_of_a_long_chain(spark):
    n = 5000
    nodes = spark.range(n).select(F.lit(1).alias("graph_id"), F.col("id").alias("node_id")).unionByName(spark.range(3).select(F.lit(2).alias("graph_id"), F.col("id").alias("node_id")))
    bonds = spark.range(n - 1).select(F.lit(1).alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src <> 2500")
    got = explain.parts_of(nodes, bonds).groupBy("graph_id", "part").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 2501), (1, 2501, 2499), (2, 0, 1), (2, 1, 1), (2, 2, 1)]


@pytest.mark.parametrize(
    "method,k,want",
    [("kcore", 2, "all"), ("anchor_nodes", 1, "ball"), ("common_neighbors", 4, "cliques"), ("jaccard", 2, "alike"), ("propagation", 3, "cliques"), ("louvain", 2, "cliques"), ("spectral", 2, "cliques"), ("components", 2, "all"), ("sbm", 2, "cliques")],
)
def test_each_treatment_of_two_joined_cliques(spark, method, k, want):
    """The bridge joins 0 and 8, the nodes of largest degree. Of 70 similar pairs 42 have the median similarity: those of the other nodes."""
    cliques = {(8 * c + i, 8 * c + j) for c in range(2) for j in range(8) for i in range(j)}
    pairs = {"cliques": cliques, "alike": {x for x in cliques if not {0, 8} & set(x)}, "all": {(i, j) for j in range(16) for i in range(j)}, "ball": {(i, j) for j in range(9) for i in range(j)}}[want]
    got = [(r.a, r.b) for r in graphs.treatment(frame(spark, sorted(cliques) + [(0, 8)]), method, k).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_treatment_by_katz_and_unknown_ones(spark):
    df = frame(spark, [(i, j) for j in range(6) for i in range(j)] + [(5, 6), (6, 7)])
    assert {tuple(r) for r in graphs.treatment(df, "katz", 2).collect()} == {(r.a, r.b) for r in graphs.katz_treatment(df, 2).collect()}
    with pytest.raises(ValueError):
        graphs.treatment(df, "none")
