"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, personal data, and the mix of sources.

Each stage takes and gives a table with the columns of ``documents``, and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontaminate, minhash, mixing, private, quality
from gneiss.llm.members import without_ids
from gneiss.llm.shared import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold; empty texts are scored like any other."""
    forest = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, forest).where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; null doc_ids stay. Of rows that repeat a doc_id the first stays, by a hash of the text and then by all columns of ``documents``."""
    verdict = written(minhash.near_duplicates(docs), "verdict")
    kept = without_ids(docs, verdict.where("not kept").select("doc_id").distinct())
    again = verdict.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        first = F.min_by(F.struct(*kept.columns), F.struct(F.xxhash64("text"), "text", "source", "lang", "n_chars")).alias("row")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("row.*"))
    return kept.select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a consistent run of a benchmark item's template."""
    leaks = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without_ids(docs, written(leaks, "leaks"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their kinds in place of personal data; ``n_chars`` is the new text's length."""
    found = private.private_spans(docs, private.learned(docs)).withColumn("text", F.col("masked"))
    return found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.sampled(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("personal_data", without_private_data),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
