"""Progress of batch runs: registration, status changes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_hash

PENDING = ["pending", "pending_llm"]
RETRIED = ["error", "pending_llm"]
OUTCOME = ["status", "country", "doc_type", "doc_category", "company", "year", "confidence", "source", "dest_path", "error_msg", "processing_time_ms", "processed_at"]


def register_files(progress: DataFrame, files: DataFrame) -> DataFrame:
    """files(file_path, folder, file_size) not yet known by the hash of their path, as pending rows."""
    new = files.withColumn("file_path_hash", path_hash(F.col("file_path"))).dropDuplicates(["file_path_hash"])
    return new.join(progress.select("file_path_hash"), "file_path_hash", "left_anti").withColumn("status", F.lit("pending"))


def pending(progress: DataFrame, folder: str | None = None) -> DataFrame:
    out = progress.filter(F.col("status").isin(PENDING))
    return (out.filter(F.col("folder") == folder) if folder else out).orderBy("id")


def record(progress: DataFrame, results: DataFrame) -> DataFrame:
    """Progress after the outcomes of some files, keyed by file_path_hash.

    A success sets all columns of ``results`` but the message, which stays; any other outcome sets status,
    message and time alone.
    """
    given = [c for c in results.columns if c != "file_path_hash" and c in progress.columns]
    got = results.select("file_path_hash", F.struct(*given).alias("_new"))
    there, ok = F.col("_new").isNotNull(), F.col("_new.status") == "ok"
    sets = {c: there if c in ("status", "processed_at") else there & ~ok if c == "error_msg" else there & ok for c in given}
    out = progress.join(got, "file_path_hash", "left")
    return out.select(*(F.when(sets[c], F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in progress.columns))


def reset_errors(progress: DataFrame, folder: str | None = None) -> DataFrame:
    """Errors and files that wait for a model become pending again, without their message."""
    hit = F.col("status").isin(RETRIED) & (F.col("folder") == folder if folder else F.lit(True))
    return progress.withColumns({"error_msg": F.when(hit, None).otherwise(F.col("error_msg")), "status": F.when(hit, "pending").otherwise(F.col("status"))})


def delete_folder(progress: DataFrame, folder: str | None) -> DataFrame:
    """Progress without the rows of a folder, or without any."""
    return progress.limit(0) if folder is None else progress.filter(~F.col("folder").eqNullSafe(folder))


def missing_files(progress: DataFrame, files: DataFrame) -> DataFrame:
    """Waiting rows whose path is not among files(file_path) become errors."""
    here = files.select(path_hash(F.col("file_path")).alias("_here")).distinct()
    out = progress.join(here, path_hash(F.col("file_path")) == F.col("_here"), "left")
    gone = F.col("status").isin(PENDING) & F.col("_here").isNull()
    return out.select(*(
        F.when(gone, "error").otherwise(F.col(c)).alias(c) if c == "status" else F.when(gone, "File not found (already moved?)").otherwise(F.col(c)).alias(c) if c == "error_msg" else F.col(c)
        for c in progress.columns
    ))


def folder_rollup(stats: DataFrame) -> DataFrame:
    """Folder statistics as shown: everything that waits is pending."""
    return stats.select("folder", "total", "ok", "errors", (F.col("pending") + F.col("pending_llm")).alias("pending"))


def seconds_until(at: Column, minute_of_day: int) -> Column:
    """Whole seconds from a time to the next time of day given in minutes, a full day if it is that time."""
    at = at.cast("timestamp")
    start = F.date_trunc("day", at) + F.make_dt_interval(mins=F.lit(minute_of_day))
    start = F.when(start <= at, start + F.make_dt_interval(days=F.lit(1))).otherwise(start)
    return F.floor(F.unix_micros(start) / 1_000_000 - F.unix_micros(at) / 1_000_000).cast("long")


def hours_minutes(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m"))


def _measures() -> list[Column]:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    status, source = F.col("status"), F.col("source")
    return [
        F.count("*").alias("total"), one(status == "ok").alias("ok"), one(status == "error").alias("errors"), one(status == "pending").alias("pending"),
        one(status == "pending_llm").alias("pending_llm"), one(source == "template_cache").alias("cache_hits"), one(source == "llm").alias("llm_calls"),
        F.avg(F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))).alias("avg_ms"),
    ]


def run_stats(progress: DataFrame) -> DataFrame:
    """One row; sums over no rows are null."""
    return _shares(progress.agg(*_measures()))


def folder_stats(progress: DataFrame) -> DataFrame:
    return _shares(progress.groupBy("folder").agg(*_measures())).orderBy("folder")


def _shares(stats: DataFrame) -> DataFrame:
    served = F.col("cache_hits") + F.col("llm_calls")
    return stats.withColumns({
        "ok_share": F.when(F.col("total") > 0, F.col("ok") / F.col("total")).otherwise(0.0),
        "cache_share": F.when(served > 0, F.col("cache_hits") / served).otherwise(0.0),
    })


def current_run(runs: DataFrame, source_root: str) -> DataFrame:
    """The newest running run of a root, if there is one."""
    return runs.filter((F.col("source_root") == source_root) & (F.col("status") == "running")).orderBy(F.desc("id")).limit(1)


def ensure_run(runs: DataFrame, source_root: str, now: Column) -> DataFrame:
    """Runs with a new running one for the root, unless it has one; its id follows the largest."""
    running = F.count_if((F.col("source_root") == source_root) & (F.col("status") == "running"))
    new = runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast(dict(runs.dtypes)["id"]).alias("id"), running.alias("_running")).filter("_running = 0")
    new = new.select("id", F.lit(source_root).alias("source_root"), F.lit("running").alias("status"), now.alias("started_at"))
    return runs.unionByName(new.select(*(c for c in new.columns if c in runs.columns)), allowMissingColumns=True)


def files_per_run(progress: DataFrame) -> DataFrame:
    return progress.groupBy("batch_run_id").agg(F.count("*").alias("total_files"))


def latest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def finish_runs(runs: DataFrame, progress: DataFrame, now: Column, run: int | None = None) -> DataFrame:
    """Runs, or the one of that id, with their totals, finished."""
    if run is not None:
        return runs.filter(F.col("id") != run).unionByName(finish_runs(runs.filter(F.col("id") == run), progress.filter(F.col("batch_run_id") == run), now))
    totals = progress.groupBy(F.col("batch_run_id").alias("id")).agg(*_measures())
    stats = totals.select("id", F.struct("total", "ok", "errors", "cache_hits", "llm_calls").alias("_s"))
    fields = {"total_files": "_s.total", "processed_files": "_s.ok", "errors": "_s.errors", "cache_hits": "_s.cache_hits", "llm_calls": "_s.llm_calls"}
    return runs.join(stats, "id", "left").select(
        *(
            F.coalesce(fields[c], F.lit(0)).cast("bigint").alias(c) if c in fields else F.lit("finished").alias(c) if c == "status" else now.alias(c) if c == "finished_at" else F.col(c)
            for c in runs.columns
        )
    )


def folder_label(folder: Column) -> Column:
    return F.when(F.length(folder) > 38, F.concat(F.substring(folder, 1, 35), F.lit("..."))).otherwise(folder)


def error_message(errors: Column, confidence: Column) -> Column:
    """Errors joined, or 'Low confidence', with the confidence."""
    text = F.when(F.size(errors) > 0, F.array_join(errors, "; ")).otherwise("Low confidence")
    return F.concat(text, F.format_string(" (conf=%.2f)", confidence))
