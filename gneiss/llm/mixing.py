"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed in cells (source, language, topic). Cell weights are raked: each round scales them to the target
shares of the sources, then of the languages, then of the topics. A cell's documents are kept with probability
``min(1, scale * weight / tokens)``, where ``scale`` spends the budget, and a document is kept if a number drawn from a
hash of its doc_id lies under that. The cells are a table like any other: they are joined, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import table, written

ROUNDS, STEP = 8, 4
BUDGET = 0.7
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SEED = "mix"
SPENDS = 8


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of text it is, from its length and its marks."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(bars * 50 > size, "table").when(size < 1000, "brief").when(size < 8000, "article").otherwise("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """``doc_id, name, source, lang, topic, tokens`` of ``docs``: the cell's keys, of which null ones are empty strings, and what the draw needs."""
    text = F.col("text").cast("string")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select("doc_id", name_of(F.col("doc_id"), text).alias("name"), key("source"), key("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))


def tempered(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """``axis, share``: target shares in proportion to the tokens to a power; below one, small groups gain."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("sum")).where("sum > 0").withColumn("sum", F.pow("sum", F.lit(power)))
    every = sums.agg(F.sum("sum")).first()[0]
    return sums.select(axis, (F.col("sum") / F.lit(every)).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: sums over each axis of ``targets`` follow its shares, as nearly as the cells allow; all weights sum to 1.

    A group without a target share, and a cell without tokens, has weight 0.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total) if total else F.lit(0.0))
    for axis, shares in targets.items():
        now = now.join(shares.withColumnRenamed("share", f"share_{axis}"), axis, "left").fillna(0.0, [f"share_{axis}"])
    for start in range(0, rounds, STEP):
        for _ in range(min(STEP, rounds - start)):
            for axis in targets:
                held = F.sum("weight").over(Window.partitionBy(axis))
                now = now.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"share_{axis}") / held).otherwise(0.0))
        now = written(now, "raked")
    return now.drop(*(f"share_{axis}" for axis in targets))


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells(tokens, weight)`` with ``probability``: expected tokens are the budget's share of all, shared out by weight; no cell gives more than it has."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    now = cells.withColumn("ratio", ratio)
    scale = 0.0
    for _ in range(SPENDS):
        full = F.col("ratio") * scale >= 1
        row = now.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("whole"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["all"] or row["open"] <= 0:
            break
        found = max(scale, (budget * row["all"] - row["whole"]) / row["open"])
        if found == scale:
            break
        scale = found
    # A document without tokens spends nothing and stays.
    return now.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("ratio") * scale)).otherwise(1.0)).drop("ratio")


def name_of(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its doc_id; without one, a hash of its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(text.cast("string")), F.lit(""))


def drawn(name: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("double") / float(16**12)


def odds_of(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``source, lang, topic, probability`` for each cell of ``docs(doc_id, text, source, lang, ...)``."""
    cells = written(cells_of(docs).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {axis: tempered(cells, axis, power) for axis, power in TEMPER.items()}
    return calibrated(raked(cells, targets, rounds), budget).select("source", "lang", "topic", F.round("probability", 9).alias("probability"))


def mixed_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, sampled`` for each row of ``docs(doc_id, text, source, lang, ...)``.

    A null or empty text has no tokens and is kept. Rows that repeat a doc_id are kept or dropped together if they are in
    one cell; rows without a doc_id are drawn by their text, so equal texts of one cell are kept or dropped together. ``targets`` gives ``share`` by source, lang or topic; without it they are the tempered shares of the
    tokens. No rows give none.
    """
    out = cells_of(docs).join(odds_of(docs, targets, budget, rounds), ["source", "lang", "topic"])
    return out.select("doc_id", "source", "lang", "topic", "tokens", "probability", (drawn(F.col("name")) < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that :func:`mixed_sources` samples, with the given columns."""
    odds = odds_of(docs, targets, budget, rounds)
    odds = odds.select(*(F.col(c).alias(f"cell_{c}") for c in odds.columns))
    same = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")) == odds[f"cell_{c}"]
    met = docs.join(odds, same("source") & same("lang") & (topic_of(docs["text"].cast("string")) == odds["cell_topic"]))
    return met.where(drawn(name_of(docs["doc_id"], docs["text"])) < F.col("cell_probability")).select(*(docs[c] for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    parts = [
        """placed AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS name, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN (length(text) - length(replace(text, '|', ''))) * 50 > length(text) THEN 'table'
    WHEN length(text) < 1000 THEN 'brief' WHEN length(text) < 8000 THEN 'article' ELSE 'long' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM placed GROUP BY ALL)",
    ]
    for axis, power in TEMPER.items():
        parts.append(f"sum_{axis} AS (SELECT {axis}, pow(sum(tokens)::DOUBLE, {power}) AS s FROM cells GROUP BY {axis} HAVING sum(tokens) > 0)")
        parts.append(f"to_{axis} AS (SELECT {axis}, s / (SELECT sum(s) FROM sum_{axis}) AS share_{axis} FROM sum_{axis})")
    parts.append("w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM cells) AS weight, " + ", ".join(f"coalesce(share_{a}, 0) AS share_{a}" for a in TEMPER) + " FROM cells " + " ".join(f"LEFT JOIN to_{a} USING ({a})" for a in TEMPER) + ")")
    n = 0
    for _ in range(ROUNDS):
        for axis in TEMPER:
            n += 1
            parts.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {axis}) > 0 THEN weight * share_{axis} / sum(weight) OVER (PARTITION BY {axis}) ELSE 0 END AS weight) FROM w{n - 1})")
    parts.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM w{n})")
    parts.append("s0 AS (SELECT 0.0::DOUBLE AS scale)")
    for k in range(1, SPENDS + 1):
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN ratio * scale >= 1 THEN 0 ELSE weight END) > 0 THEN greatest(max(scale), ({BUDGET} * sum(tokens) - sum(CASE WHEN ratio * scale >= 1 THEN tokens ELSE 0 END)) "
            f"/ sum(CASE WHEN ratio * scale >= 1 THEN 0 ELSE weight END)) ELSE max(scale) END AS scale FROM r, s{k - 1})"
        )
    parts.append(f"odds AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0, ratio * scale) ELSE 1.0 END, 9) AS probability FROM r, s{SPENDS})")
    draw = f"(('0x' || substr(md5('{SEED}:' || name), 1, 12))::BIGINT / {16**12}.0::DOUBLE)"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, tokens, probability, {draw} < probability AS sampled FROM placed JOIN odds USING (source, lang, topic)"


OP9_SQL = _op9_sql()
