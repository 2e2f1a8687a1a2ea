"""URL filters: rules on host suffixes and path prefixes, looked up by short digests.

Every URL is expanded into the host suffixes (at label boundaries) and those path prefixes whose
length some rule has. Expressions meet rules in an equi-join on the first 32 bits of SHA-256; the
full digest then confirms, and the longest rule wins (on equal length block wins, then the smaller
rule string). Only built-in functions are used.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule. Repeated
rows are judged alike and all returned. An empty rule table leaves every URL to ``default``. Columns
other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_host string, rule_path string, action string"


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, allow or block)."""
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(a).alias("action")) for h, p, a in rules]
    if not rows:
        return spark.createDataFrame([], RULE_SCHEMA)
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def split_url(url):
    """(host, path) columns of a URL column."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    rules = rules.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        F.concat_ws("\n", "rule_host", "rule_path").alias("expression"),
        F.length("rule_path").alias("path_len"),
        "action",
    ).distinct()
    # as many numbers as rule paths have lengths, so bounded by the longest rule
    lengths = F.array(*(F.lit(r["path_len"]) for r in rules.select("path_len").distinct().orderBy("path_len").collect())).cast("array<int>")

    labels = F.split("_host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    fitting = F.filter(lengths, lambda k: k <= F.length("_path"))
    prefixes = F.transform(fitting, lambda k: F.substring(F.col("_path"), F.lit(1), k))
    distinct_urls = urls.filter(F.col("_host") != "").select("_host", "_path").distinct()
    expanded = (
        distinct_urls.select("_host", "_path", F.explode(suffixes).alias("s"), prefixes.alias("p"))
        .select("_host", "_path", "s", F.explode("p").alias("p"))
        .select("_host", "_path", F.concat_ws("\n", "s", "p").alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, 8))
        .select("_host", "_path", "short", "digest")
    )
    keyed = rules.select("rule", "action", F.sha2("expression", 256).alias("rule_digest")).withColumn(
        "short", F.substring("rule_digest", 1, 8)
    )
    hits = expanded.join(keyed, "short").filter(F.col("digest") == F.col("rule_digest"))
    # max() of this struct is the longest rule; on a tie block, then the smaller string
    best = hits.groupBy("_host", "_path").agg(
        F.min(F.struct((-F.length("rule")).alias("k"), F.when(F.col("action") == "block", 0).otherwise(1).alias("b"), "rule", "action")).alias("best")
    )
    return urls.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
