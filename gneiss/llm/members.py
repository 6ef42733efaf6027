"""Rows with or without given ids, joined so that few of the other rows are shuffled.

A bitmap of hashed ids has ``2**FILTER`` bits whatever the number of ids, so it is at most ``2**(FILTER - 6)`` rows of 64
bits and may be broadcast. Rows whose bit isn't set have none of the ids; only the others meet the ids in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER = 25


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: whether a row's doc_id may be among ``ids``; no row is shuffled."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER))
    place = (F.col("_bit") % 64).cast("int")
    words = ids.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    met = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word", "left")
    set_ = F.call_function("shiftrightunsigned", F.col("_bits"), place).bitwiseAND(F.lit(1).cast("long")) == 1
    return met.withColumn("_may", F.coalesce(set_, F.lit(False))).select(*rows.columns, "_may")


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids(doc_id)``."""
    return marked(rows, ids).where("_may").drop("_may").join(ids, "doc_id", "left_semi").select(*rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in ``ids(doc_id)``; null doc_ids stay."""
    known = marked(rows, ids)
    return known.where("not _may").drop("_may").unionByName(known.where("_may").drop("_may").join(ids, "doc_id", "left_anti").select(*rows.columns))
