"""What the query modules share: the registry and the tables that stand in for the library's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Found:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two tasks; unlabelled ones have missing targets."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return docs.join(labels, "doc_id", "left")


LABELLED = "labelled AS (SELECT d.doc_id, lang, source, n_chars, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """One big graph: parts that follow each other in an order, with the number of times and the first year."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.year("l_shipdate").alias("year"))
    b = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.count("*").alias("w"), F.min("year").alias("year"))


PART_EDGES = "edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w, min(year(a.l_shipdate))::INT AS year FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL)"


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """A smaller, denser graph: suppliers that follow each other in an order."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"))
    b = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.count("*").alias("w"))


SUPPLY_EDGES = "edges AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL)"


def order_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Many small graphs: the lines of an order, chained by line number."""
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("z"), F.min(F.ascii("l_returnflag") - 65).alias("label"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long")
    nodes = lines.select(F.col("l_orderkey").alias("graph_id"), place.alias("node_id"), "x", "z", "label")
    # Numbers have no gaps, so each node but the first is bound to the one before.
    bonds = nodes.where("node_id > 1").select("graph_id", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"))
    return nodes, bonds


ORDER_GRAPHS = """lines AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS x, min(l_discount) AS z, min(ascii(l_returnflag) - 65) AS label FROM lineitem GROUP BY ALL),
nodes AS (SELECT l_orderkey AS graph_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS node_id, x, z, label FROM lines),
bonds AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1)"""


def spread(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results can be compared by value."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
