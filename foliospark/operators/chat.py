"""Prompt assembly and chat flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prepare_text, smart_truncate


def messages(text: Column, system: str, examples: list[tuple[str, str]], limit: int = 3000) -> Column:
    """array<struct<role, content>>: the system prompt, example pairs, the prepared document."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = [m(r, F.lit(c)) for pair in examples for r, c in zip(("user", "assistant"), pair)]
    return F.array(m("system", F.lit(system)), *shown, m("user", smart_truncate(prepare_text(text), limit)))


def flatten(conversations: DataFrame) -> DataFrame:
    """One prompt for each conversation: system turns first as Instructions, roles named, an open Assistant turn last."""
    line = F.when(F.col("role") == "system", F.concat(F.lit("Instructions: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), "text")).otherwise(F.concat(F.lit("User: "), "text"))
    turns = F.sort_array(F.collect_list(F.struct((F.col("role") != "system").alias("later"), "turn", line.alias("line"))))
    return conversations.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(turns, lambda t: t["line"]), "\n\n"), F.lit("\n\nAssistant:")).alias("prompt"))


def role_for_model(role: Column) -> Column:
    return F.when(role == "assistant", "model").otherwise("user")
