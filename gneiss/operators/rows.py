"""Row filters, missing targets and data checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a structure string is written with. Atoms in brackets, atoms of two letters and of one, aromatic ones, signs, ring numbers; the triple bond stands alone.
BRACKETED, TWO_LETTERS, ATOMS, AROMATIC, SIGNS, RING = r"\[[^\[\]]+\]", ("Br", "Cl"), "BCNOPSFI", "bcnops", "().=-+\\/:~@?>*$", "%[0-9]{2}|[0-9]"
TOKENS = "(" + "|".join((BRACKETED, *TWO_LETTERS, f"[{ATOMS}{AROMATIC}]", f"[{re.escape(SIGNS)}]", "#", RING)) + ")"
HEAVY = r"\[[^\[\]]*[A-GI-Za-z][^\[\]]*\]|Br|Cl|[NOSPFIBCbcnosp]"


def is_valid(structure: Column) -> Column:
    """Bulk syntax check: only known tokens, balanced brackets, ring digits in pairs, at least one heavy atom."""
    rest = F.regexp_replace(structure, r"\[[^\[\]]*\]", "C")
    closings = lambda c: F.size(F.split(rest, c)) - 1
    rings = F.forall(F.array(*(F.lit(str(d)) for d in range(1, 10))), lambda d: (F.length(rest) - F.length(F.replace(rest, d, F.lit("")))) % 2 == 0)
    known = F.length(F.regexp_replace(structure, TOKENS, "")) == 0
    return F.coalesce((F.length(structure) > 0) & known & (closings(r"\(") == closings(r"\)")) & rings & structure.rlike(HEAVY), F.lit(False))


def filter_valid(df: DataFrame, col: str, good: Column | None = None) -> DataFrame:
    """Rows whose value is among the values that pass; duplicates stay. The check runs once for each distinct value."""
    values = df.select(col).distinct().where(is_valid(F.col(col)) if good is None else good)
    return df.join(values, col, "left_semi")


def mask_targets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_mask`` (1: present) and the column with 0 for null and NaN."""
    here = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols}
    return df.withColumns({f"{c}_mask": m.cast("int") for c, m in here.items()} | {c: F.when(m, F.col(c)).otherwise(0.0) for c, m in here.items()})


def melt_tasks(df: DataFrame, ids: Sequence[str], targets: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """``ids, task, y, pred`` for every target that is there."""
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.col(t).cast("double").alias("y"), F.col(p).cast("double").alias("pred")) for t, p in zip(targets, predictions, strict=True))))
    return df.select(*ids, pairs.alias("pair")).select(*ids, "pair.*").where("y is not null and not isnan(y)")


def fill_nan_array(col: Column, value: float) -> Column:
    return F.transform(col, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(value)).otherwise(x))


def label_cardinality(df: DataFrame, col: str) -> DataFrame:
    """Number of labels: the largest, and one more if they begin at 0."""
    return df.agg((F.max(col) + F.when(F.min(col) == 0, 1).otherwise(0)).cast("long").alias("n_labels"))


def describe_dataset(df: DataFrame, tasks: Sequence[str], graph: str, classes: int = 1) -> DataFrame:
    per = df.groupBy(graph).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("n_graphs"), F.max("n").alias("max_nodes")).select("*", F.lit(len(tasks)).cast("long").alias("n_tasks"), F.lit(len(tasks) * classes).cast("long").alias("dim_target"))


def check_roles(df: DataFrame, col: str = "split") -> DataFrame:
    """``df``; a value that is no split makes the job fail."""
    good = F.col(col).isin("train", "valid", "test")
    return df.withColumn(col, F.when(good, F.col(col)).otherwise(F.raise_error(F.concat(F.lit("not a split: "), F.coalesce(F.col(col), F.lit("null"))))))


def check_aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Groups whose row counts differ between two tables."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    return a.join(b, key, "full").fillna(0, ["n_left", "n_right"]).where("n_left <> n_right")


def realign_scores(all_: DataFrame, scored: DataFrame, key: str, score: str) -> DataFrame:
    """A score for each row of ``all_``; 0 where there is none."""
    return all_.join(scored.select(key, score), key, "left").fillna(0.0, [score])
