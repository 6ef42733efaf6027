"""Queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.chat import OP3_SQL, op3_chat
from gneiss.llm.decontaminate import op7_decontaminate
from gneiss.llm.html_text import op1_html_text
from gneiss.llm.language_model import op5_language_model
from gneiss.llm.merkle import OP11_SQL, op11_merkle
from gneiss.llm.minhash import op4_minhash
from gneiss.llm.mixing import OP9_SQL, op9_mixing
from gneiss.llm.periodic import op12_periodic
from gneiss.llm.private import op6_private
from gneiss.llm.quality import op10_quality
from gneiss.llm.recompression import op13_recompression
from gneiss.llm.url_rules import OP8_SQL, op8_url_rules
from gneiss.llm.vantage import op2_vantage


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_vantage, op3_chat, op4_minhash, op5_language_model, op6_private, op7_decontaminate, op8_url_rules, op9_mixing, op10_quality, op11_merkle, op12_periodic, op13_recompression)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op8_url_rules": OP8_SQL, "op9_mixing": OP9_SQL, "op11_merkle": OP11_SQL}
