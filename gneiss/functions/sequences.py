"""Token sequences: tokens, vocabularies, encoding, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.rows import TOKENS
from gneiss.plans.rank import numbered_lines, with_index
from gneiss.plans.store import written

CLS, SEP, UNK, PAD = "[CLS]", "[SEP]", "[UNK]", "[PAD]"
UNITS = r"(\[[^\[\]]{1,10}\]|.)"


def tokenize(col: Column, pattern: str = TOKENS, compat: bool = False) -> Column:
    """Matches in order; what matches nothing is dropped. ``compat``: a bare ``#`` matches nothing, as where a line feed came before it."""
    return F.regexp_extract_all(col, F.lit(pattern.replace("|#|", "|\n#|") if compat else pattern), 1)


def load_vocab(spark, path: str) -> DataFrame:
    """``token, id`` from a file with a token a line; ids are line numbers."""
    return numbered_lines(spark, path, "id").select(F.col("value").alias("token"), "id")


def build_vocab(df: DataFrame, tokens: str) -> DataFrame:
    """``token, id`` of the distinct tokens, in order."""
    return with_index(df.select(F.explode(tokens).alias("token")).distinct(), "token", name="id")


def _with_row(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and an id of the row, written, as a stage that runs again after a lost executor could number rows otherwise."""
    return written(df.select(*cols, F.monotonically_increasing_id().alias("_row")), "rows")


def encode(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """``key, ids, n_unknown``: the vocabulary is joined to exploded tokens, so it may be of any size; empty sequences and rows that repeat a key stay."""
    flat = _with_row(df, key, tokens).select(key, "_row", F.posexplode_outer(tokens).alias("at", "token"))
    met = flat.join(vocab, "token", "left")
    held = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("id", F.lit(unknown)).alias("id")))))
    return met.groupBy(key, "_row").agg(F.transform(held, lambda x: x["id"]).alias("ids"), F.sum(F.when(F.col("at").isNotNull() & F.col("id").isNull(), 1).otherwise(0)).alias("n_unknown")).drop("_row")


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """``key, text``: tokens joined by spaces, `` ##`` taken out; a row for each row of ``df``."""
    met = _with_row(df, key, ids).select(key, "_row", F.posexplode_outer(ids).alias("at", "id")).join(vocab, "id", "left")
    held = F.sort_array(F.collect_list(F.struct("at", F.coalesce("token", F.lit(UNK)).alias("token"))))
    return met.groupBy(key, "_row").agg(F.trim(F.replace(F.array_join(F.transform(held, lambda x: x["token"]), " "), F.lit(" ##"), F.lit(""))).alias("text")).drop("_row")


def add_specials(a: Column, b: Column | None = None) -> Column:
    one = F.concat(F.array(F.lit(CLS)), a, F.array(F.lit(SEP)))
    return one if b is None else F.concat(one, b, F.array(F.lit(SEP)))


def pad(col: Column, n: int, value, right: bool = True) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(col)))
    return F.concat(col, fill) if right else F.concat(fill, col)


def encode_batch(col: Column, n: int, value) -> tuple[Column, Column]:
    """The first ``n`` items padded to ``n``, and the attention mask."""
    cut = F.slice(col, 1, n)
    return pad(cut, n, value), pad(F.transform(cut, lambda x: F.lit(1)), n, 0)


def collapse_halogen(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("Br"), F.lit("R")), F.lit("Cl"), F.lit("L"))


def split_units(col: Column) -> Column:
    """Bracketed groups of 1 to 10 characters whole, else single characters."""
    return F.regexp_extract_all(col, F.lit(UNITS), 1)


def token_profile(df: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """``token, n, known`` for each token of the corpus."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(vocab.select("token", F.lit(True).alias("known")), "token", "left").fillna(False, ["known"])


def max_length(df: DataFrame, tokens: str) -> DataFrame:
    return df.agg(F.max(F.size(tokens)).alias("max_length"))


def pad_sorted(df: DataFrame, ids: str, value: int, keep: Sequence[str]) -> DataFrame:
    """Longest first: padded to the corpus's longest, with mask and length."""
    n = df.agg(F.max(F.size(ids))).first()[0] or 0
    padded, mask = encode_batch(F.col(ids), n, value)
    return df.select(*keep, F.size(ids).alias("length"), padded.alias(ids), mask.alias("mask")).orderBy(F.col("length").desc(), *keep)
