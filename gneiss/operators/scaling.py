"""Scalers that ignore missing values, fitted as one row of parameters and applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<col>_mean`` and ``<col>_std`` (population); all missing: 0 and 1; no spread: 1."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    out = []
    for c, v in value.items():
        out += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*out)


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str], missing: float | None = None) -> DataFrame:
    """Scaled columns; missing values become ``missing``. The parameters are one row, so the broadcast is bounded."""
    met = df.join(F.broadcast(params))
    scaled = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(missing).cast("double")).otherwise((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")) for c in cols}
    return met.withColumns(scaled).drop(*(f"{c}_{p}" for c in cols for p in ("mean", "std")))


def invert_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    met = df.join(F.broadcast(params))
    return met.withColumns({c: F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in cols}).drop(*(f"{c}_{p}" for c in cols for p in ("mean", "std")))


def save_scaler(params: DataFrame, path: str, missing: float | None = 0.0) -> None:
    """Parameters beside a model: a row for each column, and what missing values become."""
    names = [c[: -len("_mean")] for c in params.columns if c.endswith("_mean")]
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"), F.lit(missing).cast("double").alias("missing")) for c in names))
    params.select(F.explode(rows).alias("x")).select("x.*").write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, cols: Sequence[str]) -> tuple[DataFrame, float | None]:
    """One row of parameters of ``cols``, as :func:`fit_scaler` gives them, and the value for missing ones."""
    rows = spark.read.schema("name string, mean double, std double, missing double").parquet(path)
    one = lambda c, v: F.max(F.when(F.col("name") == c, F.col(v)))
    return rows.agg(*(one(c, v).alias(f"{c}_{v}") for c in cols for v in ("mean", "std"))), rows.agg(F.max("missing")).first()[0]


def scale_splits(df: DataFrame, features: Sequence[str], targets: Sequence[str], role: str = "role", regression: bool = True) -> DataFrame:
    """Features scaled by the train part's parameters; targets of the train part too, for regression."""
    train = df.where(F.col(role) == "train")
    out = apply_scaler(df, fit_scaler(train, features), features)
    if not regression:
        return out
    scaled = apply_scaler(out.withColumns({f"_{t}": F.col(t) for t in targets}), fit_scaler(train, targets), targets)
    return scaled.withColumns({t: F.when(F.col(role) == "train", F.col(t)).otherwise(F.col(f"_{t}")) for t in targets}).drop(*(f"_{t}" for t in targets))


def array_params(df: DataFrame, col: str) -> DataFrame:
    """``mean, std`` arrays (one row) over the elements at each place."""
    per = df.select(F.posexplode(col).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"), F.coalesce(F.nullif(F.stddev_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    held = F.sort_array(F.collect_list(F.struct("at", "m", "s")))
    return per.agg(F.transform(held, lambda x: x["m"]).alias("mean"), F.transform(held, lambda x: x["s"]).alias("std"))


def scale_arrays(df: DataFrame, col: str, params: DataFrame) -> DataFrame:
    met = df.join(F.broadcast(params))
    centred = F.zip_with(F.col(col).cast("array<double>"), "mean", lambda x, m: x - m)
    return met.withColumn(col, F.zip_with(centred, "std", lambda x, s: x / s)).drop("mean", "std")


def normalize_scores(df: DataFrame, col: str, how: str = "minmax", positive: bool = False) -> DataFrame:
    """Attributions over all rows: ``minmax``, ``maxabs`` or ``quantile`` (share of values not above); ``positive`` fits on values over 0."""
    base = df.where(F.col(col) > 0) if positive else df
    if how == "quantile":
        counts = base.groupBy(col).agg(F.count("*").alias("_n"))
        from gneiss.plans.rank import running_sum

        total = base.count()
        ranks = running_sum(counts, col, "_n", "_upto").select(col, (F.col("_upto") / total).alias("_q"))
        return df.join(ranks, col, "left").withColumn(col, F.coalesce("_q", F.lit(0.0))).drop("_q")
    facts = base.agg(F.min(col).alias("_low"), F.max(col).alias("_high"), F.max(F.abs(col)).alias("_abs"))
    met = df.join(F.broadcast(facts))
    value = (F.col(col) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) if how == "minmax" else F.col(col) / F.nullif(F.col("_abs"), F.lit(0.0))
    return met.withColumn(col, F.coalesce(value, F.lit(0.0))).drop("_low", "_high", "_abs")
