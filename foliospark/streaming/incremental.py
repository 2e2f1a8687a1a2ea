"""Incremental, resumable classification of arriving documents with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.classify import Responder, classify, route
from ..sources.template_store import TemplateStore
from ..sources.versioned import VersionedTable

PROGRESS = "doc_id bigint, status string, source string, error_msg string, batch int"
COMPACT_EVERY = 20


def session_measures() -> dict[str, Column]:
    """What a pass over routed results counts: rows, outcomes, and how the template table was used."""
    ok, cached = F.col("status") == "ok", F.col("source") == "template_cache"
    return {
        "rows": F.count(F.lit(1)), "processed": F.count_if(F.col("status") != "pending_llm"), "ok": F.count_if(ok), "errors": F.count_if(F.col("status") == "error"),
        "pending_llm": F.count_if(F.col("status") == "pending_llm"), "cache_hits": F.count_if(ok & cached), "llm_calls": F.count_if(ok & ~cached),
        "queries": F.count_if("queried"), "hits": F.count_if(F.col("tier").isNotNull()), "dead": F.count_if(F.col("error_msg") == "All servers dead"),
    }


def write_observed(results: DataFrame, path: str) -> dict[str, int]:
    """Write routed results and return their numbers, taken in the same pass."""
    seen = Observation()
    measures = [c.cast("long").alias(k) for k, c in session_measures().items()]
    results.observe(seen, *measures).write.mode("overwrite").parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def stores(spark: SparkSession, work: str) -> tuple[TemplateStore, VersionedTable]:
    return TemplateStore(spark, f"{work}/templates"), VersionedTable(spark, f"{work}/progress", PROGRESS, "doc_id")


def read_templates(spark: SparkSession, work: str, version: int | None = None) -> DataFrame:
    """The template table of a run's folder, by default its newest version."""
    return stores(spark, work)[0].read(version)


def read_progress(spark: SparkSession, work: str) -> DataFrame:
    """doc_id, status, source, error_msg of every document, as its latest batch left it."""
    return stores(spark, work)[1].read().drop("batch")


def session_counters(spark: SparkSession, work: str) -> dict[str, float]:
    """Numbers of all batches so far, with rows a second, from the manifest alone."""
    stats = stores(spark, work)[1].manifest()["stats"]
    return stats | {"rows_per_second": stats.get("rows", 0) / stats["seconds"] if stats.get("seconds") else 0.0}


def run_incremental(
    spark: SparkSession, source: str, work: str, responder: Responder | None, max_files: int = 1000, hit_threshold: float = 0.95, cache_only: bool = False,
    compact_every: int = COMPACT_EVERY, on_batch: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Classify the Parquet files of ``source`` (doc_id, text) not yet seen, then stop.

    The checkpoint below ``work`` says which files were seen. A micro-batch reads the newest version of the
    template table, writes its routed results to a folder of its own, and commits what it learned, its hits and
    queries, then its progress, each under its number. A batch that is run again after a failure overwrites its
    own results or, if its commits were made, leaves all as it is. In a ``cache_only`` run nothing is asked.
    ``on_batch`` is given the batch's number and its observed numbers.
    """

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        templates, progress = stores(s, work)
        if progress.last_batch() >= number:
            return
        path, began = f"{work}/results/batch={number}", time.monotonic()
        if templates.last_batch() < number:
            results = route(classify(batch, templates.read(), None if cache_only else responder, hit_threshold), cache_only)
            seen = write_observed(results, path)
        else:  # the batch stopped between its two commits
            seen = {k: int(v or 0) for k, v in s.read.parquet(path).agg(*(c.alias(k) for k, c in session_measures().items())).first().asDict().items()}
        written = s.read.parquet(path)
        if templates.last_batch() < number:
            templates.record(written, F.current_timestamp(), {"queries": seen["queries"], "hits": seen["hits"]}, number)
        # a document that comes twice in one batch has one row, of its best outcome
        rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "error", 1).otherwise(2)
        rows = written.groupBy("doc_id").agg(F.min_by(F.struct("status", "source", "error_msg"), F.struct(rank, F.coalesce("error_msg", F.lit("")), "source")).alias("r")).select("doc_id", "r.*", F.lit(number).alias("batch"))
        progress.commit(rows=rows, stats=seen | {"seconds": time.monotonic() - began}, batch=number)
        templates.tidy(compact_every)
        if progress.changes() >= compact_every:
            progress.compact()
            progress.vacuum()
        if on_batch is not None:
            on_batch(number, seen)

    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
