"""Model-selection tables, early stopping and tree models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.metrics import roc_auc
from gneiss.plans.store import written

SMALLER_IS_BETTER = {"rmse", "mae", "mse", "loss"}


def grid(spark: SparkSession, config: dict[str, list]) -> DataFrame:
    """``config_id, config`` (a map) of every choice; the last key varies fastest."""
    df = spark.range(1).select(F.array().cast("array<string>").alias("v"))
    for values in config.values():
        df = df.select("v", F.posexplode(F.array(*(F.lit(str(x)) for x in values))).alias("_i", "_x")).select(F.concat("v", F.array("_x")).alias("v"))
    sizes = [len(v) for v in config.values()]
    at = F.lit(0)
    for k, (size, values) in enumerate(zip(sizes, config.values(), strict=True)):
        at = at * size + (F.array_position(F.array(*(F.lit(str(x)) for x in values)), F.get("v", F.lit(k))) - 1)
    return df.select(at.cast("int").alias("config_id"), F.map_from_arrays(F.array(*(F.lit(k) for k in config)), "v").alias("config"))


def pending(configs: DataFrame, folds: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations and folds without a result yet."""
    work = configs.withColumn("_one", F.lit(1)).join(F.broadcast(folds.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return work.join(results, ["config_id", *folds.columns], "left_anti")


def select_winner(results: DataFrame, metric: str, last: bool = False) -> DataFrame:
    """The configuration with the best mean ``value`` over folds; ties: smaller spread, then smaller id (``last``: larger id first)."""
    sign = -1 if metric.lower() in SMALLER_IS_BETTER else 1
    per = results.groupBy("config_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    order = [(sign * F.col("mean")).desc(), F.col("config_id").desc()] if last else [(sign * F.col("mean")).desc(), "std", "config_id"]
    return per.orderBy(*order).limit(1)


def assess(results: DataFrame) -> DataFrame:
    """``mean, std`` over outer folds of the mean over runs."""
    runs = results.groupBy("outer_k").agg(F.avg("value").alias("mean"))
    return runs.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"))


def stop_patience(log: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """``run, stop_epoch``: the first epoch with ``patience`` epochs since the last new minimum; null if none."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = log.withColumn("_new", before.isNull() | (F.col(loss) < before)).withColumn("_n", F.row_number().over(w))
    since = better.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_new"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return since.groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(epoch))).alias("stop_epoch"))


def stop_gl(log: DataFrame, run: str, epoch: str, loss: str, alpha: float, start: int) -> DataFrame:
    """``run, stop_epoch``: the first epoch after ``start`` epochs whose loss is over ``alpha`` percent above the best so far."""
    w = Window.partitionBy(run).orderBy(epoch)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = log.withColumn("_gl", 100 * (F.col(loss) / F.nullif(best, F.lit(0.0)) - 1)).withColumn("_n", F.row_number().over(w))
    return over.groupBy(run).agg(F.min(F.when((F.col("_n") > start) & (F.col("_gl") > alpha), F.col(epoch))).alias("stop_epoch"))


def best_epoch(log: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """The epoch with the largest score; the later of equal ones."""
    return log.groupBy(run).agg(F.max_by(epoch, F.struct(score, epoch)).alias("best_epoch"), F.max(score).alias("best"))


def argmin_blocks(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.agg(F.min_by(key, F.struct(value, key)).alias(key), F.min(value).alias(value))


def fit_trees(df: DataFrame, features: Sequence[str], label: str, kind: str = "forest", classes: bool = True, weight: str | None = None, depth: int = 4):
    """A fitted Spark ML pipeline of a forest or of boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    from pyspark.ml.feature import VectorAssembler

    made = {("forest", True): C.RandomForestClassifier, ("forest", False): R.RandomForestRegressor, ("boosted", True): C.GBTClassifier, ("boosted", False): R.GBTRegressor}
    extra = {"weightCol": weight} if weight else {}
    tree = made[kind, classes](featuresCol="_x", labelCol=label, seed=0, maxDepth=depth, **({"numTrees": 10} if kind == "forest" else {"maxIter": 5}), **extra)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), tree]).fit(df)


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, kind: str = "forest", classes: bool = True, depths: Sequence[int] = (4,), weight: str | None = None) -> DataFrame:
    """Rows of ``df`` with ``depth, prediction``, and ``score`` (the chance of class 1) where there are classes: each from trees that saw none of its fold.

    One row for each row and depth. Rows without a fold, label or feature take no part. Folds and depths are few; every fit runs on Spark.
    """
    known = written(df.dropna(subset=[*features, label, fold]), "folds")
    places = [r[0] for r in known.select(fold).distinct().orderBy(fold).collect()]
    chance = vector_to_array("probability")[1] if classes else None
    parts = []
    for depth in depths:
        for k in places:
            model = fit_trees(known.where(F.col(fold) != k), features, label, kind, classes, weight, depth)
            held = model.transform(known.where(F.col(fold) == k))
            parts.append(held.select(*df.columns, F.lit(depth).alias("depth"), "prediction", *([chance.alias("score")] if classes else [])))
    return reduce(DataFrame.unionByName, parts)


def grid_scores(held: DataFrame, label: str, fold: str) -> DataFrame:
    """``config_id, outer_k, value``: AUC of every depth and fold of :func:`out_of_fold`, in the form of :func:`select_winner`."""
    auc = roc_auc(held, ["depth", fold], label, "score")
    return auc.select(F.col("depth").alias("config_id"), F.col(fold).alias("outer_k"), F.col("auc").alias("value"))


def run_grid(df: DataFrame, features: Sequence[str], label: str, fold: str, depths: Sequence[int], folds: int):
    """A cross-validated forest over ``depths``, with the given fold column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    tree = RandomForestClassifier(featuresCol="_x", labelCol=label, seed=0, numTrees=5)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), tree])
    choices = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    return CrossValidator(estimator=pipe, estimatorParamMaps=choices, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, foldCol=fold).fit(df)
