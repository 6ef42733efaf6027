import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import quality
from gneiss.llm.language_model import BACKOFF, FLOOR, language_scores
from gneiss.llm.mixing import mixed_sources, raked, sampled, tempered
from gneiss.llm.quality import Forest, fit, held_out, learned, scored
from gneiss.llm.vantage import neighbours


def brute_scores(rows):
    bigrams, contexts, own = Counter(), Counter(), []
    for _, text in rows:
        seq = ["<b>", *(text or "").lower().split(), "</b>"]
        own.append((seq, Counter(zip(seq, seq[1:], strict=False))))
        bigrams.update(own[-1][1])
    for (a, _), n in bigrams.items():
        contexts[a] += n
    total = sum(contexts.values())
    contexts["</b>"] = len(rows)  # an end is no context, but a word that documents have
    out = []
    for seq, counts in own:
        mine, heads, score = Counter(seq), Counter(seq[:-1]), 0.0
        for (a, b), n in counts.items():
            rest = bigrams[a, b] - n
            score += n * math.log(rest / (contexts[a] - heads[a]) if rest > 0 else BACKOFF * max(contexts[b] - mine[b], FLOOR) / total)
        out.append(score)
    return out


def test_language_scores(spark):
    rows = [(1, "the cat sat on the mat"), (2, "The cat sat on a hat"), (3, "a dog ran"), (4, None), (5, ""), (6, "the cat sat on the mat"), (7, "word " * 2000)]
    got = {r.doc_id: r.log_score for r in language_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), want in zip(rows, brute_scores(rows), strict=True):
        assert abs(got[i] - want) < 1e-9 * max(1, abs(want))
    assert language_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_scores_by_every_way(spark, monkeypatch):
    """Several chunks and partitions, few frequent words and common bigrams: broadcast counts, windows and joins give one score."""
    from gneiss.llm import language_model

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(6000)]
    rows = [(i, " ".join(words[(a := rng.randrange(5000)) : a + rng.choice([0, 1, 3, 40, 300])])) for i in range(150)]
    rows += [(None, "w1 w2"), (3, "w1 w1 " * 400), (3, None), (900, rows[5][1]), (901, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("known", F.lit(1)).repartition(3)
    known = [r for r in rows if r[0] is not None]
    want = sorted(zip((i for i, _ in known), brute_scores(known), strict=True))
    for frequent, common, sample, chunk in ((8, 4, 20, 500), (1, 0, 1, 1 << 20), (1 << 18, 1 << 18, 8192, 2000)):
        for name, value in (("FREQUENT", frequent), ("COMMON", common), ("SAMPLE", sample), ("CHUNK", chunk), ("AT_ONCE", 64)):
            monkeypatch.setattr(language_model, name, value)
        got = sorted((r.doc_id, r.log_score) for r in language_scores(docs).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for (_, a), (_, b) in zip(got, want, strict=True))


def test_backing_off_to_the_end_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f")], "doc_id long, text string")
    want = 2 * math.log(BACKOFF * FLOOR / 9) + math.log(BACKOFF * 2 / 9)
    assert all(abs(r.log_score - want) < 1e-9 for r in language_scores(docs).collect())


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:140] = x[0]  # ties
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(9001, None, ""), (9002, [0.0] * 16, ""), (9003, [float("nan")] + [1.0] * 15, ""), (9004, [None] + [1.0] * 15, ""), (9005, [float("inf")] + [1.0] * 15, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours(df, df.where("vec_id % 100 = 0"), 10, 1.0, shard=700, block=17).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 3000, 100):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = sorted(range(3000), key=lambda i: (-round(scores[i], 9), i))[:10]
        assert [v for _, v in sorted(got[q])] == want
    assert neighbours(df.limit(0), df.limit(0)).count() == 0
    assert neighbours(df.where("vec_id < 5"), df.where("vec_id = 0")).count() == 4
    few = neighbours(df, df.where("vec_id % 100 = 0"), 10, 4.0, shard=700)
    assert len({(r.query_id, r.vec_id) for r in few.collect()} & {(q, v) for q, rows in got.items() for _, v in rows}) >= 0.5 * 300


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = fit(x[:1500], y[:1500])
    assert (((forest.score(x[1500:]) > 0.5) == y[1500:]).mean()) > 0.93
    assert isinstance(forest, Forest) and (fit(x[:0], y[:0]).score(x[:3]) > 0.99).all() and fit(x, np.ones(2000)).score(x[:2]).min() > 0.99


def test_quality_scores(spark):
    good = [(i, f"Here is a sentence number{i} of plain words, and it goes on for a while. Then comes another one.", "x") for i in range(120)]
    bad = [(i, f"BUY!! NOW!! BUY!! NOW!! {i}!! " * 5, "x") for i in range(120, 240)]
    docs = spark.createDataFrame([*good, *bad, (300, None, "x"), (301, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(7, None), (None, 1), (999, 1)], "doc_id long, quality int")
    forest = learned(docs, labels)
    got = {r.doc_id: r for r in scored(docs, forest).withColumn("out", held_out(F.col("doc_id"))).collect()}
    assert len(got) == 242 and all(0 <= r.score <= 1 for r in got.values())
    test = [r for r in got.values() if r.out and r.doc_id < 240]
    assert test and all((r.score > 0.7) == (r.doc_id < 120) for r in test)
    assert scored(docs.limit(0), forest).count() == 0


def test_mixing(spark):
    rows = [(i, "one two three " * (5 if i % 3 else 50), "big" if i % 3 else "small", ["en", "de", None][i % 5 % 3]) for i in range(600)] + [(900, None, None, None), (901, "", "big", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixed_sources(docs, budget=0.5).collect()
    assert len(out) == 602 and all(0 <= r.probability <= 1 for r in out)
    assert all(r.sampled for r in out if r.tokens == 0)
    kept = sampled(docs, budget=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in out)
    assert mixed_sources(docs.limit(0)).count() == 0


def test_raking_reaches_the_targets(spark):
    cells = spark.createDataFrame([(s, l, t, 10 * (i + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    targets = {a: tempered(cells, a, 0.3) for a in ("source", "lang", "topic")}
    rows = raked(cells, targets, 12).collect()
    for axis, shares in targets.items():
        for r in shares.collect():
            assert abs(sum(x.weight for x in rows if x[axis] == r[0]) - r.share) < 1e-6


def _walked(forest, row):
    total = forest.base
    for at in forest.roots:
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.cut[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_a_walk_from_each_root():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(700, 4)), 1)
    forest = fit(x, (x[:, 0] * x[:, 1] + rng.normal(size=700) > 0).astype(float), trees=12, depth=3)
    assert len(forest.roots) == 12 and forest.score(x) == pytest.approx([_walked(forest, row) for row in x])


@pytest.mark.parametrize("seed", range(5))
def test_a_split_is_the_best_of_all_cuts(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, seed % 3] + rng.normal(size=300) > 0.3).astype(float)
    forest = fit(x, y, trees=1, depth=1)
    p = y.mean()
    weight = lambda rows: ((p - y[rows]).sum(), rows.sum() * p * (1 - p))
    gain = lambda rows: weight(rows)[0] ** 2 / (weight(rows)[1] + quality.RIDGE)
    best = max((gain(low) + gain(~low), j, cut) for j in range(3) for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) if min((low := x[:, j] <= cut).sum(), (~low).sum()) >= quality.LEAST_ROWS)
    low = x[:, forest.feature[0]] <= forest.cut[0]
    assert gain(low) + gain(~low) == pytest.approx(best[0])
    for rows, leaf in ((low, forest.left[0]), (~low, forest.right[0])):
        g, h = weight(rows)
        assert forest.value[leaf] == pytest.approx(-quality.RATE * g / (h + quality.RIDGE))
