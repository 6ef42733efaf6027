"""Pairs of a group, listed and sampled, without a shuffle of them all."""

import hashlib

from pyspark.sql import functions as F

from gneiss.operators import graphs as G
from gneiss.operators import sampling
from gneiss.plans import rank


def test_sampled_pairs_are_the_first_and_few_are_written(spark, monkeypatch):
    """Pairs that come many times count once; what is written are a few of all pairs, where it was all before."""
    sizes, write = [], rank.written
    pairs = [(i, j) for i in range(120) for j in range(i)]
    a = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(rank, "written", lambda df, *x: sizes.append((out := write(df, *x)).count()) or out)
    for times, n in ((1, 20), (9, 40)):
        many = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("k")
        want = sorted(pairs, key=lambda p: hashlib.md5(f"3:{p[0]}:{p[1]}".encode()).hexdigest())[:n]
        assert sorted(tuple(r) for r in sampling.sample_pairs(many, a, n, 3).collect()) == sorted(want)
        assert max(sizes) < 1000
    assert sampling.sample_pairs(a, a, 10**5, 3).count() == len(pairs)


def test_factual_pairs_of_groups(spark):
    """As by the general operator, also where nodes are in two blocks or in none; each pair is made once and no pair is shuffled."""
    one = spark.createDataFrame([(i, None if i == 7 else i % 3) for i in range(40)], "node long, block long")
    for part in (one, one.unionByName(one), one.unionByName(one.withColumn("block", F.lit(1).cast("long")).where("node < 9"))):
        pairs = G.same_group_pairs(part.distinct())
        want = sorted(tuple(r) for r in G.factual_pairs(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), part).collect())
        assert sorted(tuple(r) for r in G.same_group_factual_pairs(part).collect()) == want
    plan = G.same_group_factual_pairs(one)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.split("Join")[0]
