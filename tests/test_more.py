"""What once lost rows or numbered them wrongly: files in parts, long chains, dense graphs, repeated keys, many groups; and readers of files."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.functions import metrics, sequences
from gneiss.operators import features, graphs, sampling, selection, splits
from gneiss.plans.rank import numbered_lines
from gneiss.plans.store import shared_folder, tables_removed, written
from gneiss.sources import tables


def test_lines_of_part_files_keep_their_order(spark, tmp_path):
    words = [f"w{i}" for i in range(20_000)]
    (tmp_path / "vocab").mkdir()
    for name, part in (("part-00000", words[:10]), ("part-00001", words[10:19_000]), ("part-00002", words[19_000:])):
        (tmp_path / "vocab" / name).write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r.token for r in sequences.load_vocab(spark, f"{tmp_path}/vocab").orderBy("id").collect()] == words
        assert numbered_lines(spark, f"{tmp_path}/vocab").where("value <> concat('w', at)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_that_repeat_a_key_stay_apart(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a"]), (2, []), (3, None)], "k long, t array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id long")
    got = sequences.encode(df, "k", "t", vocab)
    assert sorted((r.k, r.ids) for r in got.collect()) == [(1, [0, 1]), (1, [1, 0]), (2, []), (3, [])]
    assert sorted(r.text for r in sequences.decode(got.where("k = 1"), "k", "ids", vocab).collect()) == ["a b", "b a"]


def test_hops_have_no_limit(spark):
    n = 70
    nodes = spark.range(n).select(F.lit(1).alias("graph_id"), F.col("id").alias("node_id"))
    bonds = spark.range(n - 1).select(F.lit(1).alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = features.hop_distances(nodes, bonds)
    assert got.count() == n * n and got.where("hops <> abs(i - j)").count() == 0 and features.hop_distances(nodes, bonds, 2).agg(F.max("hops")).first()[0] == 2


def plain_hops(nodes, bonds, most):
    near = {}
    for g, a, b in bonds:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    out = set()
    for g, start in set(nodes):
        seen, front, k = {start}, [start], 0
        while front:
            out |= {(g, start, x, k) for x in front}
            front = {y for x in front for y in near.get((g, x), ()) if y not in seen} if most is None or k < most else set()
            seen |= front
            k += 1
    return out


@pytest.mark.parametrize("small,most", [(512, None), (512, 3), (40, None), (40, 2)])
def test_hops_of_packed_graphs_and_by_joins(spark, monkeypatch, small, most):
    """Graphs of many sizes, in several parts, with loops, repeated rows, nodes alone, ends that are no nodes, and nulls."""
    monkeypatch.setattr(features.hops, "SMALL", small)
    monkeypatch.setattr(features.hops, "PACK", 3000)
    rng = np.random.default_rng(3)
    nodes, bonds = [("g0", "x"), ("g0", "x"), ("alone", "y")], [("g0", "x", "x"), ("g0", "x", "z"), ("g0", "z", "w"), ("ends", "p", "q"), ("g0", None, "x"), (None, "a", "b")]
    for g, n in enumerate([1, 2, 5, 9, 30, 70, 130]):
        nodes += [(f"r{g}", f"n{i}") for i in range(n)]
        bonds += [(f"r{g}", f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (n, 2))]
    got = features.hop_distances(spark.createDataFrame(nodes, "graph_id string, node_id string"), spark.createDataFrame(bonds, "graph_id string, src string, dst string"), most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_hops(nodes, [b for b in bonds if None not in b], most)


def test_hops_of_nothing(spark):
    nodes, bonds = spark.createDataFrame([], "graph_id long, node_id long"), spark.createDataFrame([], "graph_id long, src long, dst long")
    assert features.hop_distances(nodes, bonds).count() == 0


def test_batches_are_padded_to_their_largest(spark):
    cells = spark.createDataFrame([(1, 1, 2, 5.0), (2, 6, 1, 7.0)], "graph_id long, i long, j long, v double")
    got = features.pad_batch(cells)
    assert got.count() == 72 and got.agg(F.sum("v")).first()[0] == 12.0


def test_batches_are_padded_by_themselves(spark):
    cells = spark.createDataFrame([("a", 1, 1, 2, 5.0), ("a", 2, 3, 1, 7.0), ("b", 3, 1, 1, 2.0)], "batch string, graph_id long, i long, j long, v double")
    got = features.pad_batch(cells, batch="batch")
    assert {(r.batch, r.n, r.v) for r in got.groupBy("batch").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()} == {("a", 18, 12.0), ("b", 1, 2.0)}


def test_nested_splits_from_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"test": [4, 2], "model_selection": [{"train": [0, 1], "validation": [3]}, {"train": [3], "validation": [0, 1]}]},\n {"test": [], "model_selection": [{"train": [5], "validation": null}]}]')
    got = {tuple(r) for r in tables.read_splits(spark, str(tmp_path / "s.json")).collect()}
    assert got == {(0, None, 4, "test"), (0, None, 2, "test"), (0, 0, 0, "train"), (0, 0, 1, "train"), (0, 0, 3, "valid"), (0, 1, 3, "train"), (0, 1, 0, "valid"), (0, 1, 1, "valid"), (1, 0, 5, "train")}


def test_written_tables_are_removed_with_their_scope(spark, tmp_path):
    outside = written(spark.range(3))
    folder = Path(shared_folder(spark).removeprefix("file://")) / "gneiss"
    before = set(folder.iterdir())
    with tables_removed(spark):
        with tables_removed(spark):
            inner = written(spark.range(5)).count()
        graphs.kcore(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).write.parquet(f"{tmp_path}/kept")
        assert set(folder.iterdir()) > before
    assert inner == 5 and outside.count() == 3 and set(folder.iterdir()) == before
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3


def test_kendall_by_inversions(spark):
    """Like all pairs, with blocks that a group spans, ties, nulls, repeated ids, a null key and groups of one row."""
    rng = random.Random(1)
    sizes = {0: 60, 1: 150, 2: 120, 3: 1, 4: 2}
    rows = [(g or None, i if g == 2 else rng.randrange(200), rng.choice([1.0, 2.0, None, float(i % 17), -0.5]), float(rng.randrange(30))) for g, n in sizes.items() for i in range(n)]
    want = {}
    for g in {r[0] for r in rows}:
        known = [r for r in rows if r[0] == g and r[2] is not None]
        signs = [(np.sign(a[2] - b[2]), np.sign(a[3] - b[3])) for k, a in enumerate(known) for b in known[:k] if a[1] != b[1]]
        if signs:
            spread = (sum(abs(p) for p, _ in signs) * sum(abs(q) for _, q in signs)) ** 0.5
            want[g] = sum(p * q for p, q in signs) / spread if spread else None
    df = spark.createDataFrame(rows, "g long, i long, y double, score double")
    for few, block in ((0, 7), (100, 1000)):
        got = {r.g: r.kendall for r in metrics.kendall(df, ["g"], "i", few=few, block=block).collect()}
        assert got == pytest.approx(want)
    assert metrics.kendall(df.limit(0), ["g"], "i").count() == 0


def test_kendall_of_a_large_group(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("y"), ((F.col("id") + n // 2) % n).alias("score"))
    half = n // 2  # the two halves change places: all pairs between them are inverted
    assert metrics.kendall(df, ["g"], "y", block=1 << 14).first()["kendall"] == pytest.approx(1 - 4 * half * half / (n * (n - 1)))


def test_trees_are_judged_on_folds_they_have_not_seen(spark):
    """Labels follow ``x`` in all folds but the last, where they are turned round: only a model that saw that fold could be right there."""
    df = spark.createDataFrame([(i, float(i % 2), i // 50) for i in range(200)], "id long, x double, fold int")
    df = df.withColumn("y", F.when(F.col("fold") == 3, 1 - F.col("x")).otherwise(F.col("x")))
    for kind in ("forest", "boosted"):
        held = selection.out_of_fold(df, ["x"], "y", "fold", kind, depths=(1, 2))
        assert held.count() == 400 and held.select("id", "depth").distinct().count() == 400
        assert held.where("fold = 3 and prediction = y").count() == 0 and held.where("fold < 3 and prediction <> y").count() == 0
    scores = {(r.config_id, r.outer_k): r.value for r in selection.grid_scores(held, "y", "fold").collect()}
    assert scores == {(d, k): float(k < 3) for d in (1, 2) for k in range(4)}


def test_non_edges_of_a_dense_graph_are_all_found(spark):
    rng = random.Random(0)
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    free = set(rng.sample(pairs, 10))
    edges = spark.createDataFrame([p for p in pairs if p not in free], "src long, dst long")
    nodes = graphs.nodes_of(edges)
    assert {tuple(r) for r in splits.sampled_non_edges(edges, nodes, 10).collect()} == free == {tuple(r) for r in splits.sampled_non_edges(edges, nodes, 50).collect()}
    again = sampling.neg_global(edges, nodes, 25).collect()
    assert sorted(r.place for r in again) == list(range(25)) and {(r.src, r.dst) for r in again} == free
    sparse = spark.createDataFrame([(i, i + 1) for i in range(400)], "src long, dst long")
    got = splits.train_negatives(sparse, graphs.nodes_of(sparse), 3).collect()
    assert len(got) == len({tuple(r) for r in got}) == 1200 and all(r.dst - r.src > 1 for r in got)


@pytest.mark.parametrize("balanced", [True, False])
def test_many_groups_are_walked_in_rounds(spark, monkeypatch, balanced):
    rng = random.Random(3)
    rows = [(g if g else None, i) for g in range(60) for i in range(rng.choice([1, 2, 3, 9, 40]))]
    df = spark.createDataFrame(rows, "g long, i long")
    roles = lambda: {r.g: r.role for r in splits.split_group(df, "g", 0.3, balanced, 5).select("g", "role").distinct().collect()}
    whole = roles()
    for most in (0, 3, 20):
        monkeypatch.setattr(splits, "WALKED", most)
        assert roles() == whole
    assert len(whole) == 60 and None in whole and sum(whole[g] == "train" for g, _ in rows) <= len(rows) - int(0.3 * len(rows))


def test_neighbours_are_among_all_vectors(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for how, e in (("euclid", d), ("cosine", 1 - x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))))):
        e = e.copy()
        np.fill_diagonal(e, np.inf)
        got = graphs.knn(df, 4, how, size=70).collect()
        assert len(got) == 1200 and all(e[r.a].argsort()[r["rank"] - 1] == r.b for r in got)
    assert {r.a for r in graphs.knn(df, 2, queries=df.where("node % 50 = 0"), size=70).collect()} == set(range(0, 300, 50))
    pairs = d[np.triu_indices(300, 1)]
    for share in (0.0, 0.1, 0.5, 1.0):
        assert abs(graphs.distance_threshold(df, share, size=70) - np.quantile(pairs, share)) < 1e-9


def test_spread_about_a_large_mean(spark):
    rng = np.random.default_rng(2)
    y = 1e9 + rng.normal(size=400)
    s = y + 0.1 * rng.normal(size=400)
    got = metrics.metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s, strict=True)], "y double, score double"), [], ["r2"]).first()[0]
    assert abs(got - (1 - ((y - s) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6


def test_more_readers(spark, tmp_path):
    (tmp_path / "c.yml").write_text("model:\n  - MPNN\n  - 'CMPNN'\nlr: [0.1, 0.01]\nseed: 7\n")
    (tmp_path / "c.json").write_text('{"model": ["MPNN"], "seed": 7}')
    assert {r.key: r["values"] for r in tables.read_config(spark, f"{tmp_path}/c.yml").collect()} == {"model": ["MPNN", "CMPNN"], "lr": ["0.1", "0.01"], "seed": ["7"]}
    assert {r.key: r["values"] for r in tables.read_config(spark, f"{tmp_path}/c.json").collect()} == {"model": ["MPNN"], "seed": ["7"]}
    for kind, rows in (("drug", ["1.5,0", "2.5,1"]), ("gene", ["3.5,4"])):
        (tmp_path / "h" / kind).mkdir(parents=True)
        (tmp_path / "h" / kind / "node-feat.csv").write_text("\n".join(rows) + "\n")
    nodes = tables.read_hetero_nodes(spark, f"{tmp_path}/h", "node-feat.csv", "x double, label int")
    assert sorted(tuple(r) for r in nodes.collect()) == [("drug", 0, 1.5, 0), ("drug", 1, 2.5, 1), ("gene", 0, 3.5, 4)]
    for role in ("train", "valid", "test"):
        if role == "train":
            df = spark.createDataFrame([([1, 2], [5, 6]), ([3, 4], None)], "edge array<long>, edge_neg array<long>")
        else:
            df = spark.createDataFrame([(1, 2, [7, 8])], "source_node long, target_node long, target_node_neg array<long>")
        df.write.parquet(f"{tmp_path}/split/{role}")
    got = [tuple(r) for r in tables.read_edge_split(spark, f"{tmp_path}/split").where("role <> 'test'").collect()]
    assert sorted(got) == [("train", 1, 2, 1), ("train", 3, 4, 1), ("train", 5, 6, 0), ("valid", 1, 2, 1), ("valid", 1, 7, 0), ("valid", 1, 8, 0)]
