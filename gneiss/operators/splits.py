"""Seeded splits: random, stratified, by group, k folds, nested; and splits of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.rank import hash_order, running_sum, with_index
from gneiss.plans.store import written


def split_random(df: DataFrame, id_: str, test: float, seed: int = 0) -> DataFrame:
    """``role``: the first ``floor(n * test)`` rows in hash order are the test part."""
    ranked = with_index(df.withColumn("_h", hash_order(seed, id_)), "_h", id_, name="_i")
    cut = int(df.count() * test)
    return ranked.withColumn("role", F.when(F.col("_i") < cut, "test").otherwise("train")).drop("_h", "_i")


def split_stratified(df: DataFrame, id_: str, y: str, test: float, seed: int = 0) -> DataFrame:
    """As :func:`split_random` within each class, ``round(n * test)`` rows of each."""
    ranked = by_class(df, id_, y, seed)
    sizes = df.groupBy(F.col(y).alias("_y")).agg(F.round(F.count("*") * test).alias("_cut"))
    return ranked.join(sizes, F.col(y).eqNullSafe(F.col("_y"))).drop("_y").withColumn("role", F.when(F.col("_i") < F.col("_cut"), "test").otherwise("train")).drop("_i", "_cut")


def by_class(df: DataFrame, id_: str, y: str, seed: int) -> DataFrame:
    """``_i``: position in its class in hash order. Classes are few and large, so positions come from a global index less the class's first."""
    ranked = with_index(df.withColumn("_h", hash_order(seed, id_)), y, "_h", id_, name="_g")
    first = ranked.groupBy(F.col(y).alias("_y")).agg(F.min("_g").alias("_first"))
    return ranked.join(first, F.col(y).eqNullSafe(F.col("_y"))).drop("_y").withColumn("_i", F.col("_g") - F.col("_first")).drop("_h", "_g", "_first")


WALKED = 100_000  # groups that one task walks through


def _walk(room: int):
    def run(groups: pa.Table) -> pa.Table:
        groups = groups.sort_by([("place", "ascending")])
        left, fits = room, []
        for n in groups.column("n").to_pylist():
            fits.append(n <= left)
            left -= n if n <= left else 0
        return pa.table({"place": groups.column("place"), "fits": pa.array(fits, pa.bool_())})

    return run


def split_group(df: DataFrame, group: str, test: float, balanced: bool = True, seed: int = 0) -> DataFrame:
    """``role``: whole groups, walked in order, go to train while they fit; a null is a group like any other.

    Unbalanced: the largest first. Balanced: groups over half the test size first, then the others, each in hash order.
    While more than ``WALKED`` groups may still fit, a round takes all before the first misfit by running sums, and drops
    those that are larger than what is left; the rest is walked in one task.
    """
    sizes = written(df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    room = n - int(n * test)
    big = F.when(F.col("n") > int(n * test) / 2, 0).otherwise(1)
    order = [big, hash_order(seed, "_group"), "_group"] if balanced else [F.col("n").desc(), "_group"]
    every = written(with_index(sizes, *order, name="place"))
    open_, taken = every.select("place", "n"), None
    while True:
        open_ = open_.where(F.col("n") <= room)
        if open_.count() <= WALKED:
            break
        sums = written(running_sum(open_, "place", "n", "upto"))
        misfit = sums.where(F.col("upto") > room).agg(F.min("place")).first()[0]
        fitting = sums if misfit is None else sums.where(F.col("place") < misfit)
        taken = fitting.select("place") if taken is None else taken.unionByName(fitting.select("place"))
        if misfit is None:
            open_ = open_.limit(0)
            break
        room -= fitting.agg(F.sum("n")).first()[0] or 0
        open_ = written(sums.where(F.col("place") > misfit).select("place", "n"))
    walked = open_.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_walk(room), "place long, fits boolean").where("fits").select("place")
    fits = (walked if taken is None else taken.unionByName(walked)).withColumn("_fits", F.lit(True))
    roles = every.join(fits, "place", "left").select("_group", F.when(F.col("_fits"), "train").otherwise("test").alias("role"))
    return df.join(roles, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def group_members(df: DataFrame, group: str, id_: str) -> DataFrame:
    return df.groupBy(group).agg(F.sort_array(F.collect_set(id_)).alias("members"))


def split_defined(df: DataFrame, col: str, test: str = "test", valid: str | None = None) -> DataFrame:
    role = F.when(F.col(col) == test, "test")
    role = role.when(F.col(col) == valid, "valid") if valid else role
    return df.withColumn("role", role.otherwise("train"))


def kfold(df: DataFrame, id_: str, k: int, seed: int = 0) -> DataFrame:
    ranked = with_index(df.withColumn("_h", hash_order(seed, id_)), "_h", id_, name="_i")
    return ranked.withColumn("fold", (F.col("_i") % k).cast("int")).drop("_h", "_i")


def kfold_stratified(df: DataFrame, id_: str, y: str, k: int, seed: int = 0) -> DataFrame:
    return by_class(df, id_, y, seed).withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


def kfold_group(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """``fold, role``: k group holdouts of n/k rows, each with a seed of its own."""
    parts = [split_group(df, group, 1 / k, True, seed + i).withColumn("fold", F.lit(i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nested_cv(df: DataFrame, id_: str, outer: int, inner: int, seed: int = 0) -> DataFrame:
    """``outer_k, inner_k, id, role``: outer test folds, and inner folds of the rest; rows of the outer test have a null inner_k."""
    folds = kfold(df.select(id_), id_, outer, seed).withColumnRenamed("fold", "own")
    folds = kfold(folds, id_, inner, seed + 1).withColumnRenamed("fold", "own_inner")
    every = folds.withColumn("outer_k", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    test = every.where("outer_k = own").select("outer_k", F.lit(None).cast("int").alias("inner_k"), id_, F.lit("test").alias("role"))
    rest = every.where("outer_k <> own").withColumn("inner_k", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    return test.unionByName(rest.select("outer_k", "inner_k", id_, F.when(F.col("inner_k") == F.col("own_inner"), "valid").otherwise("train").alias("role")))


def fold(splits: DataFrame, outer: int, inner: int | None = None) -> DataFrame:
    """Rows of one fold; without ``inner``, the outer fold with train and validation as one."""
    mine = splits.where(F.col("outer_k") == outer)
    if inner is not None:
        return mine.where((F.col("inner_k") == inner) | F.col("inner_k").isNull())
    return mine.withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train")).drop("inner_k").distinct()


def split_edges(edges: DataFrame, valid: float, test: float, seed: int = 0) -> DataFrame:
    """``src, dst, role`` for unordered pairs without loops; ``floor(n * share)`` of them in hash order are validation and test edges."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ranked = with_index(pairs.withColumn("_h", hash_order(seed, "src", "dst")), "_h", "src", "dst", name="_i")
    n = pairs.count()
    a, b = int(n * valid), int(n * valid) + int(n * test)
    return ranked.select("src", "dst", F.when(F.col("_i") < a, "valid").when(F.col("_i") < b, "test").otherwise("train").alias("role"))


def _drawn_pairs(spark: SparkSession, first: int, last: int, bits: int, seed: int) -> DataFrame:
    """``id, i, j`` for the numbers from ``first`` to ``last``: each number is another pair of ``bits`` bits each, by four rounds that swap and mix halves with a hash."""
    mask = (1 << bits) - 1
    df = spark.range(first, last).select("id", F.shiftright("id", bits).alias("i"), F.col("id").bitwiseAND(F.lit(mask)).alias("j"))
    for r in range(4):
        mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{r}:"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
        df = df.select("id", F.col("j").alias("i"), F.col("i").bitwiseXOR(mixed.bitwiseAND(F.lit(mask))).alias("j"))
    return df


def numbered_non_edges(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``place, src, dst``: ``n`` different unordered pairs of ``nodes`` that aren't edges, or all of them where there are fewer.

    The numbers from 0 on are turned into pairs one to one; pairs that are ordered, exist and aren't edges are taken as they come. The rule is
    the same for dense and sparse graphs, no pair is drawn twice, and as many numbers are drawn as the shares of edges and of other pairs
    ask for, and more if that was too few. Up to 2**31 nodes.
    """
    indexed = written(with_index(nodes.select("node").distinct(), "node", name="at"))
    count = indexed.count()
    end = lambda name, at: indexed.select(F.col("node").alias(name), F.col("at").alias(at))
    known = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    known = written(known.join(end("src", "i"), "src").join(end("dst", "j"), "dst").select("i", "j"))
    free = count * (count - 1) // 2 - known.count()
    n = min(n, free)
    bits = max(1, (count - 1).bit_length())
    first, whole, have, found = 0, 1 << (2 * bits), None, 0
    while found < n:
        last = min(whole, first + int((n - found) * whole / free * 1.05) + 1000)
        new = _drawn_pairs(edges.sparkSession, first, last, bits, seed).where("i < j").where(F.col("j") < count).join(known, ["i", "j"], "left_anti")
        have = written(new if have is None else have.unionByName(new))
        first, found = last, have.count()
    if have is None:
        return indexed.select(F.col("at").alias("place"), F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    taken = with_index(have, "id", name="place").where(F.col("place") < n)
    return taken.join(end("src", "i"), "i").join(end("dst", "j"), "j").select("place", "src", "dst")


def sampled_non_edges(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``src, dst`` of :func:`numbered_non_edges`."""
    return numbered_non_edges(edges, nodes, n, seed).select("src", "dst")


def train_negatives(edges: DataFrame, nodes: DataFrame, rate: int, seed: int = 0) -> DataFrame:
    """``rate`` times as many non-edges as there are edges, where ``rate`` is at most one less than the whole ratio of non-edges to edges, but 1 at least."""
    edges = written(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    m = edges.count()
    count = nodes.select("node").distinct().count()
    most = (count * (count - 1) // 2 - m) // m - 1 if m else 0
    return sampled_non_edges(edges, nodes, m * max(1, min(rate, most)), seed)


def check_disjoint(split: DataFrame, keys: list[str], role: str = "role") -> DataFrame:
    """Keys that are in more than one part."""
    return split.groupBy(*keys).agg(F.countDistinct(role).alias("n_roles")).where("n_roles > 1")
