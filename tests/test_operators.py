"""Fixtures by hand, properties, and brute force where SQL can't say it."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gneiss.functions import metrics
from gneiss.functions import sequences as S
from gneiss.functions.mathx import lgamma, log_binomial, log_partitions
from gneiss.operators import blocks, explain, features, graphs, likelihoods, rows, sampling, scaling, selection, splits
from gneiss.plans.rank import in_intervals, running_sum, with_index
from gneiss.sources import sinks, tables
from gneiss.streaming.early_stop import stop_patience_stream

STRUCTURES = ["CC(=O)OC1=CC=CC=C1C(=O)O", "CC#N", "C[C@H](Cl)Br", "c1ccccc1", "C(", "", None, "CC#N", "[H]", "C1CC"]


def random_edges(seed, n=40, m=120):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def near_of(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


@pytest.fixture(scope="module")
def edges(spark):
    pairs = random_edges(1)
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long"), near_of(pairs)


def test_valid_structures(spark):
    df = spark.createDataFrame(list(enumerate(STRUCTURES)), "row_id long, s string")
    assert sorted(r.row_id for r in rows.filter_valid(df, "s").collect()) == [0, 1, 2, 3, 7]


def test_tokens(spark):
    got = spark.createDataFrame([("CC#N",), ("C[C@H](Cl)Br",)], "s string").select(S.tokenize(F.col("s")).alias("a"), S.tokenize(F.col("s"), compat=True).alias("b")).collect()
    assert got[0].a == ["C", "C", "#", "N"] and got[0].b == ["C", "C", "N"] and got[1].a == ["C", "[C@H]", "(", "Cl", ")", "Br"]


def test_roles_are_checked(spark):
    df = spark.createDataFrame([("train",), ("other",)], "split string")
    with pytest.raises(Exception, match="not a split"):
        rows.check_roles(df).collect()


def test_index_and_running_sum_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    for n in (1, 8):
        assert [r.row_idx for r in with_index(df.repartition(n), "k").orderBy("k").collect()] == list(range(1000))
        assert [r.s for r in running_sum(df.repartition(n), "k", "v", "s").orderBy("k").collect()] == list(range(2, 2002, 2))


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 0, 3), ("b", 3, 3), ("c", 3, 500)], "n string, lo long, hi long")
    got = in_intervals(spark.range(400), "id", spans, "lo", "hi", 16).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in got} == {"a": 3, "c": 397}


def test_groups_stay_whole(spark):
    df = spark.range(500).select("id", F.floor(F.sqrt("id")).alias("g"))
    for r in splits.kfold_group(df, "g", 3, 1).groupBy("fold", "g").agg(F.countDistinct("role").alias("n")).collect():
        assert r.n == 1
    sizes = splits.split_group(df, "g", 0.2).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in sizes}["train"] <= 400


def test_non_edges(edges, spark):
    df, near = edges
    got = splits.sampled_non_edges(df, graphs.nodes_of(df), 60, 3).collect()
    assert len(got) == len({(r.src, r.dst) for r in got}) == 60 and all(r.src < r.dst and r.dst not in near.get(r.src, ()) for r in got)


def test_drawn_nodes_follow_degrees(edges, spark):
    df, _ = edges
    shares = {r.node: r.share for r in sampling.neg_distribution(df).collect()}
    counts = {r.node: r["count"] for r in sampling.draw_nodes(df, 8000).groupBy("node").count().collect()}
    assert sum(counts.values()) >= 7990 and all(abs(counts.get(n, 0) / 8000 - s) < 0.015 for n, s in shares.items())


def test_core_numbers(edges):
    df, near = edges
    core, left, k = {}, {n: set(v) for n, v in near.items()}, 0
    while left:
        low = [n for n in left if len(left[n]) <= k]
        if not low:
            k += 1
            continue
        for n in low:
            core[n] = k
            for m in left.pop(n):
                if m in left:
                    left[m].discard(n)
    assert {r.node: r.core for r in graphs.kcore(df).collect()} == core


def test_parts_and_hops(edges, spark):
    df, near = edges
    seen, todo = {0: 0}, [0]
    while todo:
        n = todo.pop(0)
        for m in near.get(n, ()):
            if m not in seen:
                seen[m] = seen[n] + 1
                todo.append(m)
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.dist for r in graphs.hops_from(df, start).collect()} == seen
    lone = df.unionByName(spark.createDataFrame([(90, 91, 1)], df.schema))
    got = {r.node: r.component for r in graphs.components(lone).collect()}
    assert got[90] == got[91] == 90 and all(got[n] == min(seen) for n in seen)


def test_communities_beat_chance(spark):
    rng = random.Random(2)
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.5 if a // 20 == b // 20 else 0.02)}
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long")
    truth = spark.range(60).select(F.col("id").alias("node"), F.floor(F.col("id") / 20).alias("block"))
    for part in (graphs.louvain(df), blocks.em_partition(df, truth, 2)):
        assert graphs.modularity(df, part).first().modularity > 0.3
    assert graphs.spectral(df, 3).count() == 60 and abs(graphs.largest_eigenvalue(df) - 10) < 4


def test_counterfactual_pairs(spark):
    near = spark.createDataFrame([(a, b, abs(a - b) / 10) for a in range(6) for b in range(6) if abs(a - b) <= 2], "a long, b long, distance double")
    treated = spark.createDataFrame([(0, 1), (1, 0), (4, 5), (5, 4)], "a long, b long")
    pairs = spark.createDataFrame([(0, 1), (2, 4)], "a long, b long")
    got = {(r.a, r.b): (r.c, r.d, r.matched) for r in graphs.counterfactual_pairs(pairs, treated, near, 0.3).collect()}
    assert got == {(0, 1): (0, 2, True), (2, 4): (4, 5, True)}
    none = graphs.counterfactual_pairs(pairs, treated.limit(0), near, 0.3).collect()
    assert all((r.a, r.b) == (r.c, r.d) and not r.matched for r in none)


def test_gamma(spark):
    xs = [0.5, 1.0, 1.5, 3.0, 17.0, 1234.5, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) < 1e-8 * max(1, abs(math.lgamma(r.x))) for r in got)
    assert abs(spark.range(1).select(log_binomial(F.lit(10), F.lit(3)).alias("v")).first().v - math.log(120)) < 1e-8
    assert abs(log_partitions(10, 10) - math.log(42)) < 1e-12


def test_equal_partitions_agree(spark):
    part = spark.createDataFrame([(i, i % 3) for i in range(30)], "node long, block long")
    assert abs(blocks.nmi(part, part).first().nmi - 1) < 1e-9 and blocks.nmi(part, part.withColumn("block", F.lit(0))).first().nmi == 0
    assert blocks.random_partition(part, 5).select("block").distinct().count() == 5
    with pytest.raises(ValueError, match="unknown"):
        blocks.penalty("x", 1, 1, 1)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (float("nan"), None, 5.0)], "a double, b double, c double")
    p = scaling.fit_scaler(df, ["a", "b", "c"])
    assert tuple(p.first()) == (2.0, 1.0, 0.0, 1.0, 5.0, 1.0)
    assert [r.a for r in scaling.invert_scaler(scaling.apply_scaler(df, p, ["a"], 0.0), p, ["a"]).collect()] == [1.0, 3.0, 2.0]


def test_degenerate_metrics(spark):
    df = spark.createDataFrame([("t", 1.0, 0.3), ("t", 1.0, 0.4), ("u", 1.0, 0.3), ("u", 0.0, 0.3)], "task string, y double, pred double")
    assert {r.task: r.value for r in metrics.multitask(df).collect()} == {"t": None, "u": 0.5}
    few = spark.createDataFrame([(1, 0.9), (2, 0.2)], "k long, score double")
    assert [r.hits for r in metrics.hits_at(few, few, (1, 2, 20)).collect()] == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.metrics(df.withColumnRenamed("pred", "score"), ["task"], "nothing")


def test_winner(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (1, 2.0), (2, 1.0), (2, 1.0)], "config_id long, value double")
    assert selection.select_winner(df, "auc").first().config_id == 1 and selection.select_winner(df, "RMSE").first().config_id == 2
    assert selection.select_winner(df, "auc", last=True).first().config_id == 1


def test_scaffolds(spark):
    ring = [(1, i, i % 6 + 1) for i in range(1, 7)]
    bonds = spark.createDataFrame([*ring, (1, 6, 7), (2, 1, 2)], "graph_id long, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in range(1, 8)] + [(2, 1), (2, 2)], "graph_id long, node_id long")
    assert sorted((r.graph_id, r.node_id) for r in features.scaffold_atoms(nodes, bonds).collect()) == [(1, i) for i in range(1, 7)]


def test_bond_features(spark):
    df = spark.createDataFrame([(1, 1, 2, "DOUBLE", True, False, 0), (1, 2, 3, None, False, False, 0)], "graph_id long, src long, dst long, type string, conjugated boolean, ring boolean, stereo int")
    got = [r.features for r in features.bond_features(df).orderBy("src").collect()]
    assert got == [[0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0], [1, *[0] * 13]]


def test_fragments(spark):
    nodes = spark.createDataFrame([(g, n, "abc"[n % 3], float(n != 3)) for g in range(5) for n in range(6)], "graph_id long, node_id long, label string, score double")
    bonds = spark.createDataFrame([(g, n, n + 1) for g in range(5) for n in range(5)], "graph_id long, src long, dst long")
    got = explain.top_fragments(nodes, bonds, "label", 0.5, 5).collect()
    assert [r.n for r in got] == [5, 5]  # nodes 0 to 2, and 4 and 5, of each graph


def test_files(spark, tmp_path):
    record = "name\n  prog\n\n  2  1  0  0\n    1.0000    2.0000    3.0000 C   0  0\n    0.0000    0.0000    0.5000 O   0  0\n  1  2  2  0\nM  END\n> <y>\n4.5\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(record + "\n\n$$$$\n" + record)
    atoms, bonds, props = tables.read_sdf(spark, str(tmp_path / "a.sdf"))
    assert sorted((r.record_id, r.atom_idx, r.symbol, r.z) for r in atoms.collect()) == [(1, 1, "C", 3.0), (1, 2, "O", 0.5), (3, 1, "C", 3.0), (3, 2, "O", 0.5)]
    assert [tuple(r) for r in bonds.orderBy("record_id").collect()] == [(1, 1, 2, 2), (3, 1, 2, 2)] and [tuple(r) for r in props.orderBy("record_id").collect()] == [(1, "y", "4.5"), (3, "y", "4.5")]
    for name, lines in {"graph_indicator": [1, 1, 2], "node_labels": [0, 1, 1], "A": ["1, 2", "2, 1"], "graph_labels": ["1.5", "None"]}.items():
        (tmp_path / f"d_{name}.txt").write_text("\n".join(map(str, lines)))
    nodes, edges, ys = tables.read_tu(spark, str(tmp_path / "d"))
    assert nodes.count() == 3 and sorted(map(tuple, edges.collect())) == [(1, 1, 2), (1, 2, 1)] and [r.y for r in ys.orderBy("graph_id").collect()] == [[1.5], [None]]
    (tmp_path / "n.dat").write_text("1\t2\n2\t1\n2\t3\n")
    (tmp_path / "c.dat").write_text("1\t1\n2\t1\n3\t2\n")
    net, part = tables.read_network_community(spark, str(tmp_path / "n.dat"), str(tmp_path / "c.dat"))
    assert sorted(map(tuple, net.collect())) == [(0, 1), (1, 2)] and part.count() == 3
    assert tables.dataset_config(spark, "esol", {"metric": "mae"}).first().metric == "mae"
    vocab = spark.createDataFrame([("b", 1), ("a", 0)], "token string, id long")
    sinks.write_vocab(vocab, str(tmp_path / "v"))
    assert sorted(map(tuple, S.load_vocab(spark, str(tmp_path / "v")).collect())) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="consecutive"):
        sinks.write_vocab(vocab.where("id = 1"), str(tmp_path / "w"))
    built = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), lambda: built.append(1) or vocab).count() == 2
    assert built == [1]


def test_stream_stops_like_the_batch(spark, tmp_path):
    rng = random.Random(5)
    log = [(run, e, rng.random() + (0 if e < 6 else 1)) for run in range(5) for e in range(1, 20)]
    df = spark.createDataFrame(log, "run long, epoch long, loss double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {r.run: r.stop_epoch for r in selection.stop_patience(df, "run", "epoch", "loss", 4).collect() if r.stop_epoch is not None}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stop_patience_stream(stream, 4).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.run: r.stop_epoch for r in spark.table("stops").collect()} == want


def test_gains_are_score_differences(spark):
    pairs = [(a, b) for a, b in random_edges(4, 14, 50) if a < b]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long")
    part = spark.createDataFrame([(n, n % 3) for n in range(14)], "node long, block long")
    before = blocks.score(df, part, "DCKN").first().score
    for r in blocks.move_gains(df, part).orderBy("node", "block").limit(4).collect():
        moved = part.withColumn("block", F.when(F.col("node") == r.node, r.block).otherwise(F.col("block")))
        assert abs(blocks.score(df, moved, "DCKN").first().score - before - r.gain) < 1e-6


def test_numbers_of_partitions():
    assert log_partitions(7, 1) == log_partitions(0, 3) == log_partitions(5000, 1) == 0 and log_partitions(4, 0) == -math.inf
    for m, n in ((1200, 3), (1200, 6), (1500, 40), (2000, 2000)):
        exact = log_partitions(m, n, 10**6)
        assert abs(log_partitions(m, n) - exact) < 0.01 * exact


@pytest.mark.parametrize("directed", [False, True])
def test_hyperprior_likelihood_is_a_direct_sum(spark, directed):
    rng = random.Random(7)
    block = {i: i % 3 for i in range(12)}  # nodes 10 and 11 have no edges
    rows = [(rng.randrange(10), rng.randrange(10)) for _ in range(40)]
    e = spark.createDataFrame(rows, "src long, dst long").groupBy("src", "dst").agg(F.count("*").alias("w"))
    part = spark.createDataFrame(list(block.items()), "node long, block int")
    f = lambda x: math.lgamma(x + 1)
    choose = lambda n, k: f(n) - f(k) - f(n - k)
    twice = lambda x: x * math.log(2) + f(x)
    out, in_ = Counter(a for a, _ in rows), Counter(b for _, b in rows)
    sizes = Counter(block.values())
    want = -choose(9 + 39 if directed else 6 + 39, 40) - f(12) - choose(11, 2) - math.log(12) + sum(f(n) for n in sizes.values())
    between = Counter((block[a], block[b]) for a, b in rows) if directed else Counter(tuple(sorted((block[a], block[b]))) for a, b in rows)
    pairs = Counter(rows) if directed else Counter(tuple(sorted(r)) for r in rows)
    weigh = lambda k, x: twice(x) if k[0] == k[1] and not directed else f(x)
    want += sum(weigh(k, x) for k, x in between.items()) - sum(weigh(k, x) for k, x in pairs.items())
    ends = [out, in_] if directed else [out + in_]
    for k in ends:
        want += sum(f(x) for x in k.values())
    for r, n in sizes.items():
        for k in ends:
            d = sum(x for i, x in k.items() if block[i] == r)
            want -= f(d) + log_partitions(d, n)
        want -= f(n)
    want += sum(f(c) for c in Counter((b, *(k[i] for k in ends)) for i, b in block.items()).values())
    assert abs(likelihoods.flat_likelihood(e, part, "hyperprior", directed).first()[0] - want) < 1e-6
    # A hierarchy of one level replaces the prior of block counts by those of the cells and of the level above.
    flat, high = (likelihoods.flat_likelihood(e, part, None, directed).first()[0], likelihoods.hierarchy_likelihood(e, [part], None, directed).first()[0])
    places = lambda k: sizes[k[0]] * sizes[k[1]] if directed or k[0] != k[1] else sizes[k[0]] * (sizes[k[0]] + 1) / 2
    assert abs(high - flat + sum(choose(places(k) + x - 1, x) for k, x in between.items()) + math.log(3)) < 1e-6


def test_penalties():
    n, m, log = 10, 30, math.log
    assert blocks.penalty("AIC", n, m, 3) == 9 and blocks.penalty("AIC", n, m, 3, True, True) == 15
    assert abs(blocks.penalty("BIC", n, m, 3) - 3 * log(100)) < 1e-9 and abs(blocks.penalty("BIC_SPARSE", n, m, 3, True) - 4.5 * log(1000)) < 1e-9
    assert abs(blocks.penalty("ICL", n, m, 3) - (log(10) + 3 * log(45))) < 1e-9
    assert abs(blocks.penalty("MDL_TRADITIONAL", n, m, 3) - (30 * log(3) + 6 * log(30))) < 1e-9
    assert abs(blocks.penalty("MDL_FIRST", n, m, 3) - (30 * (1.2 * log(1.2) - 0.2 * log(0.2)) + 10 * log(3))) < 1e-9
    with pytest.raises(ValueError):
        blocks.penalty("ICL", n, m, 3, corrected=True)
    assert set(blocks.PENALTIES["DCKN"]) == set(blocks.PENALTIES["SKN"]) - {"ICL"}


def test_nodes_of_small_shares_are_drawn(spark):
    # 2**21 nodes of one degree: on a grid of 2**20 slots only every other one could be drawn.
    edges = spark.range(1 << 20).select((2 * F.col("id")).alias("src"), (2 * F.col("id") + 1).alias("dst"))
    got = [r.node % 2 for r in sampling.draw_nodes(edges, 1000).collect()]
    assert len(got) == 1000 and 400 < sum(got) < 600
