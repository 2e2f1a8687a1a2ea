"""A deterministic test double in the place of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import with_entities


def stub_responder(rows: DataFrame) -> DataFrame:
    """Answers with what the entities and the hint say; not a model, and not to be compared with one."""
    found = with_entities(rows.withColumnRenamed("company_hint", "_hint"), "ask_text")
    answer = F.to_json(F.struct("country", F.lit("invoice").alias("doc_type"), F.col("_hint").alias("company"), "year"))
    out = found.withColumn("raw_response", F.when(F.col("ask_text").isNotNull(), answer)).withColumnRenamed("_hint", "company_hint")
    return out.select(*rows.columns, "raw_response")
