"""Exact positions in a global order without a window over all rows, and joins of positions with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.plans.store import written


def with_index(df: DataFrame, *order: str | Column, name: str = "row_idx") -> DataFrame:
    """``df`` and its 0-based position in ``order``: range partitions, sorted each, plus the sizes of those before."""
    width = 1 << 33
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("_id", F.monotonically_increasing_id()))
    part = F.floor(F.col("_id") / width)
    sizes = placed.groupBy(part.alias("_part")).count()
    # One row for each partition, so the window and the broadcast are bounded by their number.
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.withColumn(name, (F.col("_before") + F.col("_id") % width).cast("long")).drop("_id", "_part", "_before")


def numbered_lines(spark: SparkSession, path: str, name: str = "at", **options) -> DataFrame:
    """``value`` and its 0-based position in a file, or in a folder's part files by their names, however Spark reads them."""
    lines = spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return with_index(lines, "_file", "_block", "_line", name=name).select("value", name)


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` and the sum of ``value`` over rows up to each in ``order`` (a unique key), in two levels like :func:`with_index`."""
    width = 1 << 33
    placed = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.floor(F.col("_id") / width))
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_id"))
    met = placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return met.withColumn(name, F.col("_before") + own).drop("_id", "_part", "_before")


def in_intervals(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: int = 64) -> DataFrame:
    """Points joined to the intervals ``low <= at < high`` as an equi-join on bins of ``width`` positions."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    dealt = intervals.where(F.col(high) > F.col(low)).withColumn("_bin", F.explode(bins))
    met = points.withColumn("_bin", F.floor(F.col(at) / width)).join(dealt, "_bin")
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bin")


def hash_order(seed: int | str, *ids: str | Column) -> Column:
    """A reproducible random order: md5 of the seed and the ids; the same in any SQL engine."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *(c.cast("string") for c in cols))))


def first_by_hash(df: DataFrame, n: int, seed: int | str, *ids: str, digits: int = 5) -> DataFrame:
    """The first ``n`` rows of ``df`` by :func:`hash_order` of ``ids``, or all where there are fewer, without a sort of the table or a task that holds ``n``.

    Rows are counted by the first ``digits`` of their hashes. Those before the digits that hold the n-th row are kept as they are; only
    the rows that share its digits are brought in order, in range partitions.
    """
    hashed = written(df.withColumn("_h", hash_order(seed, *ids)))
    counts = written(running_sum(hashed.groupBy(F.substring("_h", 1, digits).alias("_d")).agg(F.count("*").alias("_n")), "_d", "_n", "_upto"))
    edge = counts.where(F.col("_upto") >= n).agg(F.min(F.struct("_d", (F.col("_upto") - F.col("_n")).alias("before")))).first()[0]
    if edge is None:
        return hashed.drop("_h")
    own = F.substring("_h", 1, digits)
    last = with_index(hashed.where(own == edge["_d"]), "_h", *ids, name="_i").where(F.col("_i") < n - edge["before"])
    return hashed.where(own < edge["_d"]).drop("_h").unionByName(last.drop("_h", "_i"))


def first_different_by_hash(df: DataFrame, n: int, seed: int | str, *ids: str) -> DataFrame:
    """As :func:`first_by_hash` of the different rows of ``df``, which has the columns ``ids`` alone, without writing or shuffling them all.

    Equal rows have equal hashes. Rows whose hashes are so small that about twice ``n`` are expected are kept, and only those told apart; four times as
    many follow as long as fewer than ``n`` differ. So ``df`` has to give the same rows each time.
    """
    total = df.count()
    want, hashed = 2 * n + 10 * int(n**0.5) + 100, df.select(*ids).withColumn("_h", hash_order(seed, *ids))
    while want < total:
        low = written(hashed.where(F.col("_h") < f"{(want << 60) // total:015x}").drop("_h").distinct(), "low")
        if low.count() >= n:
            return first_by_hash(low, n, seed, *ids)
        want *= 4
    return first_by_hash(df.select(*ids).distinct(), n, seed, *ids)
