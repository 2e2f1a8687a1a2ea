"""The numbered queries over the synthetic tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, conversation_trie, decontamination, embedding_dedup, jaccard_join, language_id, pii, secret_scans, substring_dedup, tokenizer_alignment, toxicity, training_order, url_filters

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(secret_scans.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), url_filters.rules_table(spark, URL_RULES))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), shingle=4, threshold=(85, 100))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_order(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.filter("not held_out"))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.align(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), keep=["doc_id", "held_out"])


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rh, rp, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(rh || rp, length(rh || rp)) FROM r
        WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)) AS rule,
       coalesce((SELECT arg_max(action, length(rh || rp)) FROM r
        WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)), 'allow') AS verdict
FROM h
"""


def queries() -> dict:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_pii": op3_pii,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_url_filters": op6_url_filters,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_training_order": op8_training_order,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_language_id": op10_language_id,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6_SQL}
