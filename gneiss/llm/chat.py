"""Chat formatting with Spark expressions only: one string for each conversation, and its loss mask.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block. A block is
``<|role|>text<|end|>``, and ``<|sep|>`` stands between the texts of one block. Inside texts and roles each backslash
is doubled and a backslash is put into every control string, so that none is left and :func:`unescaped` restores all.
The loss mask holds the spans (code points) of the texts of the assistant's blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import table

# Control strings of this template and of two common ones.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END, SEP = "<|end|>", "<|sep|>"
LEARNED = "assistant"
RUN, PAGE = 256, 4096  # turns whose spans are added up together, code points of a page
SAMPLE = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """``conv_id, formatted, loss_spans`` (array of ``start, length`` in code points) for each conversation of ``turns(conv_id, turn, role, text, ...)``.

    Turns are taken by turn, then role, then text, so ties have one order and repeated rows stay. A null text or role
    is empty; null turns come first; rows with a null conv_id form one conversation. No rows give no conversations.
    """
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    same = lambda i: (i > 0) & (F.get("turns", i - 1)["role"] == F.get("turns", i)["role"])
    last = lambda i: (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != F.get("turns", i)["role"])
    open_ = lambda x, i: F.when(same(i), F.lit(SEP)).otherwise(F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>")))
    parts = F.transform("turns", lambda x, i: F.struct(open_(x, i).alias("open"), escaped(x["text"]).alias("text"), F.when(last(i), F.lit(END)).otherwise(F.lit("")).alias("shut"), (x["role"] == learned).alias("learned"), same(i).alias("same")))
    held = held.select("conv_id", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["text"], p["shut"])), "")
    return held.select("conv_id", text.alias("formatted"), _loss_spans(F.col("parts")).alias("loss_spans"))


def _loss_spans(parts: Column) -> Column:
    """Where the learned texts stand, in code points.

    Spans of ``RUN`` turns at a time are added up from nought, then moved to where their run begins, so an array that grows is copied for a run
    of turns or for a number a run, not for each turn of a long conversation.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["open"])
        length = F.length(p["text"])
        span = F.struct(start.alias("start"), length.alias("length"))
        kept = F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + length + F.length(p["shut"])).alias("at"), kept.alias("spans"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice(parts, r * RUN + 1, RUN), zero, step))
    heads = lambda held: F.aggregate(held, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
    moved = lambda x: F.flatten(F.transform(x["runs"], lambda r, i: F.transform(r["spans"], lambda s: F.struct((s["start"] + F.get(x["heads"], i)).alias("start"), s["length"].alias("length")))))
    return _once(_once(runs, lambda held: F.struct(held.alias("runs"), heads(held).alias("heads"))), moved)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_back(df: DataFrame) -> DataFrame:
    """``conv_id, turns (array of role, text), learned`` from ``formatted`` and ``loss_spans`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b, i: b != "")
    role = lambda b: unescaped(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1))
    texts = lambda b: F.split(F.regexp_replace(b, r"(?s)^<\|.*?\|>", ""), r"<\|sep\|>")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text")))))

    def under(pages: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / PAGE).cast("int"), F.floor((s["start"] + s["length"]) / PAGE).cast("int")
        return F.substring(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), s["start"] - first * PAGE + 1, s["length"])

    # A span is cut from the pages that it meets, as finding a place in a string means to walk there from the string's start.
    pages = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    learned = _once(pages, lambda held: F.array_join(F.transform("loss_spans", lambda s: unescaped(under(held, s))), ""))
    return df.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    back = read_back(formatted(given.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escaped(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for control in CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


OP3_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAMPLE}'), (-7, 1, 'assistant', '{SAMPLE}')
), marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same, lead(role) OVER w IS DISTINCT FROM role AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  sum(CASE WHEN same THEN {len(SEP)} ELSE 4 + length({_sql_escaped("role")}) END + length({_sql_escaped("text")}) + CASE WHEN last THEN {len(END)} ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
