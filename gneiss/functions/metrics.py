"""Metrics as grouped aggregates over ``(by..., y, score)``; ranked ones go through the distinct scores of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gneiss.plans.inversions import BLOCK, count_inversions, weighted_inversions
from gneiss.plans.rank import with_index
from gneiss.plans.store import written


def _safe(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; null where either doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def _counts(y: Column, p: Column) -> tuple[Column, Column, Column]:
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return hit((p == 1) & (y == 1)), hit((p == 1) & (y != 1)), hit((p != 1) & (y == 1))


#: Metrics that users add: from the columns of truths and scores to an aggregate.
REGISTERED: dict[str, Callable[[Column, Column], Column]] = {}


def register_metric(name: str, made: Callable[[Column, Column], Column]) -> None:
    """From now on ``name``, case aside, is ``made(y, score)``, an aggregate expression."""
    REGISTERED[name.lower()] = made


def simple(name: str, y: Column, s: Column) -> Column:
    """One-pass metrics; ``s`` is rounded half to even where a class is needed."""
    p = F.rint(s)
    tp, fp, fn = _counts(y, p)
    sse, n = F.sum((y - s) ** 2), F.count(y)
    sst = F.var_pop(y) * n  # by the spread about the mean: a difference of sums would cancel where the mean is large
    made = {
        "accuracy": F.avg((y == p).cast("double")), "precision": _safe(tp, tp + fp), "recall": _safe(tp, tp + fn), "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "positive": F.avg(y), "mse": F.avg((y - s) ** 2), "rmse": F.sqrt(F.avg((y - s) ** 2)), "mae": F.avg(F.abs(y - s)), "r2": 1 - _safe(sse, sst, None),
        "pearson": correlation(y, s), "count": n.cast("double"),
    }
    if name.lower() in REGISTERED:
        return REGISTERED[name.lower()](y, s).alias(name.lower())
    if name.lower() not in made:
        raise ValueError(f"unknown metric: {name}")
    return made[name.lower()].alias(name.lower())


def metrics(df: DataFrame, by: Sequence[str], names: Sequence[str] | str, y: str = "y", score: str = "score") -> DataFrame:
    """A column for each name, case aside; an unknown name is an error."""
    names = [names] if isinstance(names, str) else names
    return df.groupBy(*by).agg(*(simple(n, F.col(y).cast("double"), F.col(score).cast("double")) for n in names))


def _steps(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """For each distinct score of a group: positives and negatives there (``p, n``) and at or above it (``tp, fp``), and the group's totals."""
    at = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return at.select(*by, "_s", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(all_).alias("all_p"), F.sum("n").over(all_).alias("all_n"))


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties averaged; null for a group of one class."""
    steps = _steps(df, by, y, score)
    return steps.groupBy(*by).agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.max("all_p") * F.max("all_n"), F.lit(0))).alias("auc"))


def pr_auc(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Trapezoid under precision and recall, and average precision (steps)."""
    steps = _steps(df, by, y, score).withColumn("prec", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("rec", F.col("tp") / F.nullif(F.col("all_p"), F.lit(0)))
    w = Window.partitionBy(*by).orderBy(F.col("_s").desc())
    steps = steps.withColumn("d", F.col("rec") - F.coalesce(F.lag("rec").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("prec").over(w), F.lit(1.0)))
    return steps.groupBy(*by).agg(F.sum(F.col("d") * (F.col("prec") + F.col("before")) / 2).alias("pr_auc"), F.sum(F.col("d") * F.col("prec")).alias("average_precision"))


def macro(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Macro precision, recall and F1 over the classes seen in truth or prediction."""
    seen = df.select(*by, F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(y) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x")).select(*by, "x.*")
    per = seen.groupBy(*by, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return per.groupBy(*by).agg(F.avg(_safe(F.col("h"), F.col("p"))).alias("precision"), F.avg(_safe(F.col("h"), F.col("t"))).alias("recall"), F.avg(_safe(2 * F.col("h"), F.col("t") + F.col("p"))).alias("f1"))


def average_rank(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """``df`` and the mean rank of ties in each group, through the group's distinct values."""
    counts = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(counts.select(*by, col, (upto - (F.col("_n") - 1) / 2).alias(name)), [*by, col])


def spearman(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    return average_rank(average_rank(df, by, y, "_ry"), by, score, "_rs").groupBy(*by).agg(correlation(F.col("_ry"), F.col("_rs")).alias("spearman"))


SUMS = ("pairs", "num", "dy", "ds")


def _alike(by: Sequence[str]) -> Column:
    """Keys equal to those that :func:`_renamed` gave other names, null to null."""
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), F.lit(True))


def _renamed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})


def _sums_by_pairs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., pairs, num, dy, ds`` of small groups: all pairs, those in one direction less those in opposite ones, and pairs that differ in ``_y`` and in ``_s``."""
    other = _renamed(df, by).withColumnsRenamed({"_who": "_j", "_y": "_y2", "_s": "_s2"})
    met = df.join(other, _alike(by) & (F.col("_who") < F.col("_j"))).select(*by, F.signum(F.col("_y") - F.col("_y2")).alias("dy"), F.signum(F.col("_s") - F.col("_s2")).alias("ds"))
    return met.groupBy(*by).agg(F.count("*").cast("double").alias("pairs"), F.sum(F.col("dy") * F.col("ds")).alias("num"), F.sum(F.abs("dy")).alias("dy"), F.sum(F.abs("ds")).alias("ds"))


def _sums_by_inversions(df: DataFrame, by: Sequence[str], block: int) -> DataFrame:
    """The same of large groups, over all pairs of their rows, from numbers of ties and inversions."""
    cells = df.groupBy(*by, "_y", "_s").agg(F.count("*").alias("w"))
    placed = written(with_index(with_index(cells, *by, "_y", "_s", name="a"), *by, "_s", "_y", name="b"), "orders")
    starts = placed.groupBy(*by).agg(F.min("a").alias("group"))
    flips = count_inversions(placed.join(_renamed(starts, by), _alike(by)).select("group", "a", "b", "w"), block)
    # What a number of equal or inverted pairs adds to pairs, num, dy and ds.
    signs = {(): (1, 1, 1, 1), ("_y",): (0, -1, -1, 0), ("_s",): (0, -1, 0, -1), ("_y", "_s"): (0, 1, 0, 0)}

    def part(found: DataFrame, pairs: Column, sign: tuple[int, ...]) -> DataFrame:
        return found.select(*by, *((pairs * k).alias(n) for n, k in zip(SUMS, sign, strict=True)))

    parts = [part(placed.groupBy(*by, *cols).agg(F.sum("w").alias("t")), F.col("t") * (F.col("t") - 1) / 2, sign) for cols, sign in signs.items()]
    parts.append(part(flips.join(starts, "group"), F.col("inversions").cast("double"), (0, -2, 0, 0)))
    return _summed(reduce(DataFrame.unionByName, parts), by)


def _sums_in_tasks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same of groups that a task can hold many of: a group's rows come in one row and are counted with those of others."""
    rows = df.groupBy(*by).agg(F.collect_list(F.struct("_y", "_s")).alias("_rows")).where(F.size("_rows") > 1)

    def tied(*ranks: np.ndarray) -> np.ndarray:
        """Pairs of equal ranks by group, which the first ranks begin with."""
        order = np.lexsort(ranks[::-1])
        first = np.flatnonzero(np.any([np.diff(r[order], prepend=-1) != 0 for r in ranks], axis=0))
        n = np.diff(np.append(first, len(order)))
        return np.bincount(ranks[0][order][first], n * (n - 1) / 2)

    def counted(batches):
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("_rows")).to_numpy())])
            low = 0
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 16), side="right")) - 1)  # groups of few rows together
                part = b.slice(low, high - low)
                held = part.column("_rows").flatten()
                group = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
                y, s = (np.unique(held.field(i).to_numpy(zero_copy_only=False), return_inverse=True)[1] for i in (0, 1))
                order = np.lexsort((s, y, group))
                found = weighted_inversions(group[order] * (s.max() + 1) + s[order], np.ones(len(order), np.int64))
                pairs, flips = tied(group), np.bincount(group[order], found)
                dy, ds = pairs - tied(group, y), pairs - tied(group, s)
                sums = [pairs, dy + ds - pairs + tied(group, y, s) - 2 * flips, dy, ds]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in by), *map(pa.array, sums)], [*by, *SUMS])
                low = high

    return rows.mapInArrow(counted, StructType([*rows.select(*by).schema.fields, *(StructField(n, DoubleType()) for n in SUMS)]))


def _summed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(n).alias(n) for n in SUMS))


def kendall(df: DataFrame, by: Sequence[str], id_: str, y: str = "y", score: str = "score", few: int = 32, block: int = BLOCK, most: int = 2048) -> DataFrame:
    """``by..., kendall``: tau-b over the pairs of a group of any size.

    Groups of up to ``few`` rows list their pairs; for larger ones ties and inversions are counted instead, less those among rows of one id,
    which tasks count where an id has up to ``most`` rows of a group.
    Rows without label, score or id take no part, nor do NaN ones; two rows of one id are no pair; null keys are one group. Groups without
    a pair are left out; where all labels or all scores are equal the value is null.
    """
    known = df.select(*by, F.col(id_).alias("_who"), F.col(y).alias("_y"), F.col(score).alias("_s")).dropna(subset=["_who", "_y", "_s"])
    # Written, so that the planner knows how few they are: rows of few large groups aren't shuffled by group.
    large = _renamed(written(known.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > few).drop("_n"), "large"), by)
    many = written(known.join(large, _alike(by), "left_semi"), "many")
    key = [*by, "_who"]
    often = written(many.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"), "often")
    if often.isEmpty():
        twins = _sums_in_tasks(many, key)
    else:
        often = _renamed(often, key)
        twins = _sums_in_tasks(many.join(often, _alike(key), "left_anti"), key).unionByName(_sums_by_inversions(many.join(often, _alike(key), "left_semi"), key, block))
    apart = twins.select(*by, *((-F.col(n)).alias(n) for n in SUMS))
    parts = [_sums_by_pairs(known.join(large, _alike(by), "left_anti"), by), _sums_by_inversions(many, by, block), apart]
    sums = _summed(reduce(DataFrame.unionByName, parts), by)
    spread = F.sqrt(F.col("dy") * F.col("ds"))
    return sums.where("pairs > 0").select(*by, (F.col("num") / F.nullif(spread, F.lit(0.0))).alias("kendall"))


def multitask(df: DataFrame, classification: bool = True) -> DataFrame:
    """``task, value`` over ``(task, y, pred)``: AUC or RMSE; null where labels or 0/1 predictions are constant."""
    if not classification:
        return metrics(df.withColumnRenamed("pred", "score"), ["task"], "rmse").withColumnRenamed("rmse", "value")
    spread = df.groupBy("task").agg((F.min("y") == F.max("y")).alias("one"), ((F.min("pred") == F.max("pred")) & F.min("pred").isin(0.0, 1.0)).alias("flat"))
    return roc_auc(df, ["task"], "y", "pred").join(spread, "task").select("task", F.when(~F.col("one") & ~F.col("flat"), F.col("auc")).alias("value"))


def hits_at(positives: DataFrame, negatives: DataFrame, ks: Sequence[int] = (20, 50, 100), score: str = "score") -> DataFrame:
    """``k, hits``: share of positives above the k-th best negative; 1 with fewer than k negatives. At most ``max(ks)`` negatives are ranked."""
    top = negatives.select(score).orderBy(F.col(score).desc()).limit(max(ks))
    held = top.agg(F.sort_array(F.collect_list(score), asc=False).alias("top")).first()["top"]
    out = [F.avg((F.col(score) > held[k - 1]).cast("double") if len(held) >= k else F.lit(1.0)).alias(str(k)) for k in ks]
    row = positives.agg(*out)
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("hits")) for k in ks))).alias("x")).select("x.*")


def mrr(positives: DataFrame, negatives: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Mean reciprocal rank of each positive among its negatives; a tie takes the mean of the best and worst rank."""
    met = positives.select(key, F.col(score).alias("_p")).join(negatives.select(key, F.col(score).alias("_n")), key, "left")
    rank = met.groupBy(key).agg((1 + F.sum(F.when(F.col("_n") > F.col("_p"), 1.0).when(F.col("_n") == F.col("_p"), 0.5).otherwise(0.0))).alias("r"))
    return rank.agg(F.avg(1 / F.col("r")).alias("mrr"))


def over_folds(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def multiclass_auc(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """``micro, macro``: AUC of all (row, class) pairs at once, and the mean of one-against-rest AUCs of the classes that have one."""
    flat = df.select(F.posexplode(probabilities).alias("c", "score"), F.col(label).alias("_y")).select("c", "score", (F.col("c") == F.col("_y")).cast("int").alias("y"))
    micro = roc_auc(flat.withColumn("_all", F.lit(0)), ["_all"]).select(F.col("auc").alias("micro"))
    return micro.join(F.broadcast(roc_auc(flat, ["c"]).agg(F.avg("auc").alias("macro"))))
