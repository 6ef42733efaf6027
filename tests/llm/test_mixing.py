import duckdb
from pyspark.sql import functions as F

from gneiss.llm.mixing import OP9_SQL, mixed_sources, sampled

SCHEMA = "doc_id long, text string, source string, lang string, tokens string, topic string, weight string"


def rows_of(n):
    kinds = ["", None, "w " * 30, "long word " * 200, "a | b | c\n" * 40, "word " * 9000]
    return [(i if i % 7 else None, f"{kinds[i % 6]}{i // 12 if i % 6 > 1 else ''}" if kinds[i % 6] is not None else None, ["a", "b", None][i % 3 if i % 5 else 0], ["en", "de", None][i % 4 % 3], "x", "y", "z") for i in range(n)]


def test_matches_sql_with_nulls_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(240), SCHEMA)
    got = sorted(map(repr, map(tuple, mixed_sources(docs).collect())))
    frame = docs.select("doc_id", "text", "source", "lang").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(map(repr, con.execute(OP9_SQL).fetchall()))
    assert got == want


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    """They aren't all kept or all dropped; equal rows share their fate, and a repeated id in one cell does too."""
    rows = [(None, f"text number {i} " + "word " * 40, "a", "en", "", "", "") for i in range(200)]
    rows += [(None, rows[0][1], "a", "en", "", "", ""), (5, "five " * 50, "a", "en", "", "", ""), (5, "5 " * 50, "a", "en", "", "", "")]
    out = mixed_sources(spark.createDataFrame(rows, SCHEMA), budget=0.5).withColumn("n", F.lit(1))
    shares = {r.sampled: r.n for r in out.where("doc_id is null").groupBy("sampled").agg(F.sum("n").alias("n")).collect()}
    assert shares[True] > 60 and shares[False] > 60
    assert out.where("doc_id = 5").select("sampled").distinct().count() == 1
    kept = sampled(spark.createDataFrame(rows, SCHEMA), budget=0.5)
    assert kept.columns == spark.createDataFrame(rows, SCHEMA).columns and kept.count() == out.where("sampled").count()
    assert kept.where(F.col("text") == rows[0][1]).count() in (0, 2)
