"""Writers: feature caches, splits, predictions, results, graph bundles, vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.plans.rank import running_sum, with_index


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def save_splits(df: DataFrame, path: str) -> None:
    """Partitioned by data set, kind of split and seed."""
    df.write.mode("append").partitionBy("dataset", "split_type", "seed").parquet(path)


def oof_rows(df: DataFrame, id_: str, preds: str, label: str, multi_class: bool = False) -> DataFrame:
    """``id, pred, label``: the prediction, or the place of the largest of an array."""
    pred = F.array_position(preds, F.array_max(preds)) - 1 if multi_class else F.col(preds)
    return df.select(id_, pred.alias("pred"), F.col(label).alias("label"))


def write_oof(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_results(df: DataFrame, path: str, flat: bool = False) -> None:
    df.write.option("header", True).csv(path) if flat else df.write.json(path)


def tu_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Global node numbers from 1 by graph and node, and both directions of each edge in them."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    starts = running_sum(sizes, "graph_id", "n", "_u").select("graph_id", (F.col("_u") - F.col("n")).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id"))
    numbered = nodes.withColumn("_r", rank).join(starts, "graph_id").withColumn("number", F.col("_s") + F.col("_r")).drop("_r", "_s")
    end = lambda c: numbered.select("graph_id", F.col("node_id").alias(c), F.col("number").alias(f"_{c}"))
    met = edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    pair = F.explode(F.array(F.struct(F.col("_src").alias("a"), F.col("_dst").alias("b")), F.struct(F.col("_dst").alias("a"), F.col("_src").alias("b"))))
    return numbered, met.select("graph_id", pair.alias("x")).select("graph_id", "x.*")


def write_tu(nodes: DataFrame, edges: DataFrame, prefix: str) -> None:
    """``_graph_indicator`` and ``_A`` as sorted text."""
    numbered, both = tu_tables(nodes, edges)
    numbered.orderBy("number").select(F.col("graph_id").cast("string")).write.text(f"{prefix}_graph_indicator.txt")
    both.orderBy("a", "b").select(F.concat_ws(", ", "a", "b")).write.text(f"{prefix}_A.txt")


def vocab_gaps(vocab: DataFrame) -> DataFrame:
    """Ids that don't follow their predecessor: positions and ids of a sound vocabulary are equal."""
    return with_index(vocab, "id", name="_i").where("id <> _i").select("id")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """A token a line, in order of ids, which must be consecutive from 0."""
    if not vocab_gaps(vocab).isEmpty():
        raise ValueError("ids aren't consecutive")
    vocab.orderBy("id").select("token").write.text(path)
