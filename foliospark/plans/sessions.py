"""Sessions of a long batch: runs, registered files, what became of each, retries, and totals.

A folder holds three versioned tables: templates, files by the hash of their path, and runs. A session
registers what is new, looks for the files that wait, classifies them in one pass, learns and counts hits,
and records outcomes; each step is a commit, so a session that dies is taken up by the next one.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import destination
from ..operators import progress as P
from ..operators.free_names import resolve_conflicts
from ..operators.ranking import running_sum
from ..operators.templates import template_stats
from ..sources.moves import move_files_journaled
from ..sources.template_store import TemplateStore
from ..sources.versioned import VersionedTable
from ..streaming.incremental import write_observed
from .classify import ROUTE_CONFIDENCE, Responder, classify, keyed, route

FILES = (
    "file_path_hash string, id bigint, batch_run_id bigint, file_path string, folder string, file_size bigint, status string, country string, doc_type string, doc_category string, "
    "company string, year int, confidence double, source string, dest_path string, error_msg string, processing_time_ms bigint, processed_at timestamp"
)
RUNS = "id bigint, source_root string, started_at timestamp, finished_at timestamp, status string, total_files bigint, processed_files bigint, cache_hits bigint, llm_calls bigint, errors bigint"
MOST_CHANGES = 20


class Sessions:
    """The sessions kept below a folder."""

    def __init__(self, spark: SparkSession, work: str):
        self.spark, self.work = spark, work.rstrip("/")
        self.templates = TemplateStore(spark, f"{self.work}/templates")
        self.files = VersionedTable(spark, f"{self.work}/files", FILES, "file_path_hash")
        self.runs = VersionedTable(spark, f"{self.work}/runs", RUNS, "id")

    def _run(self, source_root: str, now: Column) -> int:
        """The id of the root's running run; a new one if it has none."""
        before = self.runs.read()
        found = P.current_run(before, source_root).first()
        if found is None:
            after = P.ensure_run(before, source_root, now)
            self.runs.commit(rows=after.join(before.select("id"), "id", "left_anti"))
            found = P.current_run(self.runs.read(), source_root).first()
        return found["id"]

    def register(self, files: DataFrame, run: int) -> int:
        """Add files(file_path, folder, file_size) not yet known, numbered by folder and path; returns how many there were."""
        known = self.files.read()
        last = known.agg(F.max("id")).first()[0] or 0
        new = P.register_files(known, files.select("file_path", "folder", "file_size"))
        numbered = running_sum(new, [], ["folder", "file_path", "file_path_hash"], "id")
        rows = numbered.withColumns({"id": F.col("id") + last, "batch_run_id": F.lit(run).cast("long")})
        given = set(rows.columns)
        n = rows.count()
        self.files.commit(rows=rows.select(*(F.col(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in self.files.types.items())))
        total = P.files_per_run(self.files.read()).filter(F.col("batch_run_id") == run).first()
        runs = self.runs.read().filter(F.col("id") == run)
        self.runs.commit(rows=runs.withColumn("total_files", F.lit(total["total_files"] if total else 0).cast("long")))
        return n

    def run(
        self, files: DataFrame, source_root: str, responder: Responder | None, folder: str | None = None, cache_only: bool = False, hit_threshold: float = 0.95,
        min_confidence: float = ROUTE_CONFIDENCE, now: Column | None = None, journal: str | None = None, existing: DataFrame | None = None, suffix: str = "-sort",
    ) -> dict[str, int]:
        """One session over files(file_path, folder, file_size, text) that are there now; returns its numbers.

        Files that wait in the folders of ``files`` are taken up, those no longer there become errors. Successes
        get a destination beside their folder, and move there if a ``journal`` folder is given. The run ends with
        the session unless documents found no living server: these wait, and the next session goes on.
        """
        now = F.current_timestamp() if now is None else now
        here = files if folder is None else files.filter(F.col("folder") == folder)
        run = self._run(source_root, now)
        registered = self.register(here, run)
        table = self.files.read()
        waiting = P.pending(table).join(here.select("folder").distinct(), "folder", "left_semi")
        gone = P.missing_files(waiting, here.select("file_path")).filter("status = 'error'").withColumn("processed_at", now)
        self.files.commit(rows=gone.select(*self.files.types))
        began = time.monotonic()
        responder = None if cache_only else responder
        # without a responder only keys and lengths are needed, and texts stay where they are read
        texts = keyed(here.select(P.path_hash(F.col("file_path")).alias("file_path_hash"), "text"), responder is not None).dropDuplicates(["file_path_hash"])
        docs = waiting.select("file_path_hash", F.col("id").alias("doc_id")).join(texts, "file_path_hash").drop("file_path_hash")
        results = route(classify(docs, self.templates.read(), responder, hit_threshold), cache_only, min_confidence)
        path = f"{self.work}/results/{self.files.manifest()['version']:012d}"
        seen = write_observed(results, path)
        written = self.spark.read.parquet(path)
        self.templates.record(written, now, {"queries": seen["queries"], "hits": seen["hits"]})
        got = waiting.select("id", "file_path_hash", "file_path").join(written.withColumnRenamed("doc_id", "id"), "id")
        got = self._placed(got, suffix, existing, journal)
        share = int((time.monotonic() - began) * 1000 / max(1, seen["rows"]))  # of a batch, not of one file
        outcome = got.withColumns({"processing_time_ms": F.lit(share).cast("long"), "processed_at": now})
        done = P.record(table, outcome.select("file_path_hash", *P.OUTCOME))
        self.files.commit(rows=done.join(got.select("file_path_hash"), "file_path_hash", "left_semi").select(*self.files.types), stats={k: seen[k] for k in ("processed", "ok", "errors", "cache_hits", "llm_calls")})
        if not seen["dead"]:
            self.runs.commit(rows=P.finish_runs(self.runs.read(), self.files.read(), now, run).filter(F.col("id") == run))
        self.templates.tidy(MOST_CHANGES)
        if self.files.changes() >= MOST_CHANGES:
            self.files.compact()
            self.files.vacuum()
        return seen | {"registered": registered, "run": run}

    def _placed(self, got: DataFrame, suffix: str, existing: DataFrame | None, journal: str | None) -> DataFrame:
        """Destinations of successes, and their moves; a file that could not be moved waits with the reason."""
        folder, name = F.regexp_replace("file_path", "/[^/]*$", ""), F.regexp_extract("file_path", "[^/]*$", 0)
        parts = [F.col(c) for c in ("country", "doc_category", "doc_type", "company")]
        target = destination(F.concat(folder, F.lit(suffix)), parts, F.col("year"), name)
        placed = resolve_conflicts(got.withColumn("dest_path", F.when(F.col("status") == "ok", target)), "dest_path", "file_path", existing)
        if journal is None:
            return placed
        moved = move_files_journaled(placed, journal).filter("error is not null").select(F.col("source").alias("_source"), F.col("error").alias("_failed"))
        out = placed.join(moved, F.col("file_path") == F.col("_source"), "left")
        failed = F.col("_failed").isNotNull()
        return out.withColumns({"status": F.when(failed, "pending_llm").otherwise(F.col("status")), "error_msg": F.when(failed, F.col("_failed")).otherwise(F.col("error_msg"))}).drop("_source", "_failed")

    def retry(self, folder: str | None = None) -> int:
        """Errors and files that wait for a model become pending; returns how many."""
        before = self.files.read()
        rows = P.reset_errors(before, folder)
        changed = rows.join(before.filter(F.col("status").isin(P.RETRIED)).select("file_path_hash"), "file_path_hash", "left_semi").filter("status = 'pending'")
        n = changed.count()
        if n:
            self.files.commit(rows=changed.select(*self.files.types))
        return n

    def reset(self, folder: str | None = None) -> int:
        """Forget the files of a folder, or all; returns how many."""
        before = self.files.read()
        gone = before.join(P.delete_folder(before, folder).select("file_path_hash"), "file_path_hash", "left_anti").select("file_path_hash")
        n = gone.count()
        if n:
            self.files.commit(deletes=gone)
        return n

    def status(self) -> dict[str, DataFrame]:
        """overall, folders (with shown names), the latest runs, and the template table: its numbers, and its queries and hits."""
        files = self.files.read()
        totals = self.templates.totals()
        stats = P.folder_stats(files)
        cache = self.spark.createDataFrame([tuple(totals.values())], "total_queries long, total_hits long, hit_rate double")
        return {"overall": P.run_stats(files), "folders": stats.withColumn("shown", P.folder_label(F.col("folder"))), "runs": P.latest_runs(self.runs.read()), "templates": template_stats(self.templates.read()), "cache": cache}
