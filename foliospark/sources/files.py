"""File sources and sinks: PDF bytes through a pluggable parser, template exchange, reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.ranking import running_sum
from ..store import materialize, release
from .isolated import Isolated, NoResult
from .moves import place

BLOCK = "array<struct<page:int,y:double,x:double,text:string>>"
#: Larger files get one attempt only.
ISOLATE_BYTES = 500_000
MAX_PAGES, TIMEOUT_SECONDS = 5, 30.0
IMAGES = "*.{jpg,jpeg,png}"
REPORT = ["source", "destination", "status", "country", "doc_type", "company", "year", "confidence", "error"]


def scan_pdfs(spark: SparkSession, root: str, recursive: bool = True, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of matching files; glob '*.[pP][dD][fF]' for any case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(root)


def signature(files: DataFrame) -> Column:
    """Key of the list of files that failed before."""
    return F.concat_ws(";", files["path"], files["length"].cast("string"), files["modificationTime"].cast("long").cast("string"))


def scan_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    return scan_pdfs(spark, root, recursive, IMAGES)


def folders(files: DataFrame, root: str, suffix: str = "-sort") -> DataFrame:
    """The root, if it holds files itself, and its direct subfolders that do, sorted; not those of earlier output."""
    root = root.rstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^file:/+", "/")
    below = F.substring(inside, len(root) + 2, 1_000_000)
    found = files.select(inside.alias("folder"), below.alias("below")).distinct()
    return found.filter(((F.col("folder") == root) | F.col("folder").startswith(root + "/")) & ~F.contains("below", F.lit("/")) & ~F.col("folder").endswith(suffix)).select("folder").orderBy("folder")


def join_blocks(blocks: Column) -> Column:
    """Text of layout blocks in reading order: page, then y, then x, each rounded to a tenth."""
    r = lambda v: F.bround(v, 1)
    rows = F.filter(F.transform(blocks, lambda b: F.struct(b["page"], r(b["y"]).alias("y"), r(b["x"]).alias("x"), trim(b["text"]).alias("text"))), lambda b: b["text"] != "")
    return F.array_join(F.transform(F.array_sort(rows), lambda b: b["text"]), "\n\n")


def extract(
    files: DataFrame, parser: Callable[[bytes], list[tuple]], max_pages: int = MAX_PAGES, timeout: float = TIMEOUT_SECONDS, structured: bool = True, badlist: DataFrame | None = None
) -> DataFrame:
    """path, signature, text, status (ok, blocked, error, timeout, no-result), error, listed through ``parser``: bytes to (page, y, x, text) blocks.

    The parser runs in a child process that is killed at the time limit. Files up to ``ISOLATE_BYTES`` that are
    not on the list of bad ones get a second attempt. Files that fail are ``listed``, also if the second attempt
    works; an encrypted file (PermissionError) is not. A failure is one of its file only. Without ``structured``
    blocks are joined as they come, by line ends.
    """
    key = signature(files).alias("signature")
    rows = files.select("path", key, "content", (F.col("length") <= ISOLATE_BYTES).alias("small"))
    if badlist is None:
        rows = rows.withColumn("again", F.col("small"))
    else:
        bad = badlist.select("signature", F.lit(True).alias("_bad")).distinct()
        rows = rows.join(bad, "signature", "left").withColumn("again", F.col("small") & F.col("_bad").isNull())
    pickled = cloudpickle.dumps(parser)

    def one(child: Isolated, content: bytes) -> tuple[list[dict], str, str | None]:
        try:
            return [dict(zip(("page", "y", "x", "text"), b)) for b in child(content, timeout) if b[0] < max_pages], "ok", None
        except PermissionError as e:
            return [], "blocked", str(e)
        except TimeoutError as e:
            return [], "timeout", str(e)
        except NoResult as e:
            return [], "no-result", str(e)
        except Exception as e:  # noqa: BLE001  one bad file must not end the job
            return [], "error", str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = Isolated(pickled)
        try:
            for batch in batches:
                found = []
                for path, sign, content, again in zip(batch["path"], batch["signature"], batch["content"], batch["again"]):
                    got = one(child, content)
                    listed = got[1] not in ("ok", "blocked")
                    if listed and again:
                        got = one(child, content)
                    found.append((path, sign, *got, listed))
                yield pd.DataFrame(found, columns=["path", "signature", "blocks", "status", "error", "listed"])
        finally:
            child.close()

    schema = f"path string, signature string, blocks {BLOCK}, status string, error string, listed boolean"
    parsed = rows.select("path", "signature", "content", "again").mapInPandas(run, schema)
    text = join_blocks(F.col("blocks")) if structured else F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return parsed.select("path", "signature", text.alias("text"), "status", "error", "listed")


def bad_files(extracted: DataFrame, badlist: DataFrame | None = None) -> DataFrame:
    """The list of bad files after an extraction: signature."""
    new = extracted.filter("listed").select("signature")
    return (new if badlist is None else badlist.select("signature").unionByName(new)).distinct()


def is_readable(text: Column, status: Column) -> Column:
    return (F.length(trim(text)) > 0) & (status == "ok")


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates that ``export_templates`` wrote, or an array of them in one file; columns that it lacks are null."""
    schema = "id bigint, fingerprint string, header_hash string, company_hint string, country string, doc_type string, doc_category string, company string, confidence double, hit_count bigint, created_at timestamp, last_hit_at timestamp"
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def export_templates(templates: DataFrame, path: str, compat: bool = False) -> None:
    """Templates as JSON lines, most used first; ``compat`` leaves out what older readers ignore."""
    out = templates.drop("id", "header_hash", "created_at") if compat else templates
    out.orderBy(F.desc("hit_count"), "fingerprint").write.mode("overwrite").json(path)


def write_results_csv(results: DataFrame, path: str, columns: list[str]) -> None:
    """Results as CSV with a header, also if there are none."""
    results.select(*(F.format_string("%.2f", c).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in results.select(*columns).dtypes)).write.mode("overwrite").option("header", True).csv(path)


def report_rows(plan: DataFrame) -> DataFrame:
    """The rows of a report from an organize plan with ``file_path``."""
    return plan.select(F.col("file_path").alias("source"), F.col("dest_path").alias("destination"), "status", "country", "doc_type", "company", "year", "confidence", F.coalesce("error", "message").alias("error"))


def write_report_csv(plan: DataFrame, path: str) -> None:
    write_results_csv(report_rows(plan), path, REPORT)


def write_report_json(plan: DataFrame, path: str) -> None:
    """``summary`` (one JSON object with the counters) and ``results`` (JSON lines by status) below ``path``; see ``write_report_document`` for one document."""
    _json_counts(plan).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    about = F.struct("country", "doc_type", "company", "year", "confidence").alias("classification")
    report_rows(plan).select("source", "destination", "status", about, "error").write.mode("overwrite").partitionBy("status").json(f"{path}/results")


def _json_counts(plan: DataFrame) -> DataFrame:
    """One row of counters: totals by status, maps by country and type of what succeeded."""
    one = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    success = F.col("status") == "success"
    sections = F.array(one("status", F.col("status")), one("country", F.when(success, F.coalesce("country", F.lit("unknown")))), one("doc_type", F.when(success, F.coalesce("doc_type", F.lit("unknown")))))
    counts = plan.select(F.explode(sections).alias("s")).filter("s.key is not null").groupBy("s.section", "s.key").agg(F.count("*").alias("n"))
    status = lambda v: F.coalesce(F.sum(F.when((F.col("section") == "status") & (F.col("key") == v), F.col("n"))), F.lit(0))
    by = lambda section: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("key", "n")))))  # noqa: E731  a row for each country or type
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("section") == "status", F.col("n"))), F.lit(0)).alias("total_files"), status("success").alias("successful"), status("trash").alias("moved_to_trash"),
        status("skipped").alias("skipped"), status("error").alias("errors"), by("country").alias("by_country"), by("doc_type").alias("by_doc_type"),
    )


def write_json_document(rows: DataFrame, path: str, order: list[str], summary: DataFrame | None = None) -> None:
    """One JSON document ``{"summary": .., "results": [..]}`` with the rows in order, written by all tasks at once.

    Every row's place in the file is the running sum of the lengths before it, so tasks write theirs where they
    belong, into a file that gets its name when all is written. No task and not the driver holds the rows; the
    driver writes the one row of the summary. ``path`` lies in a folder that all executors share.
    """
    lines = rows.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_line"))
    length = F.octet_length("_line") + 2
    placed = materialize(running_sum(lines, [], [*(F.asc_nulls_first(f"_o{i}") for i in range(len(order))), "_line"], "_end", length).select("_line", "_end"), "lines")
    head = "{"
    if summary is not None:
        head += f'"summary": {summary.select(F.to_json(F.struct(*summary.columns)).alias("s")).first()["s"]},\n'
    start = (head + '"results": ').encode()
    total = placed.agg(F.max("_end")).first()[0] or 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    made = os.path.join(os.path.dirname(os.path.abspath(path)), f".{uuid.uuid4().hex}.part")
    with open(made, "wb") as f:
        f.write(start + b"[" * (not total))
        f.seek(len(start) + (total or 1))
        f.write(b"\n]}\n")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = os.open(made, os.O_WRONLY)
        try:
            for batch in batches:
                for line, end in zip(batch["_line"], batch["_end"]):
                    data = line.encode()
                    at = end - len(data) - 2
                    os.pwrite(file, (b"[\n" if at == 0 else b",\n") + data, len(start) + at)
                yield pd.DataFrame({"n": [len(batch)]})
            os.fsync(file)
        finally:
            os.close(file)

    placed.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    os.replace(made, path)
    release(placed)


def write_report_document(plan: DataFrame, path: str) -> None:
    """The report of an organize plan with ``file_path`` as one JSON document: counters, then results by source."""
    about = F.struct("country", "doc_type", "company", "year", "confidence").alias("classification")
    write_json_document(report_rows(plan).select("source", "destination", "status", about, "error"), path, ["source"], _json_counts(plan))


def move_files(plan: DataFrame, copy: bool = False) -> DataFrame:
    """source, destination, error: carries a plan's moves out in tasks, on paths that they all share; nothing else moves files.

    Nothing at a destination is replaced. A task that is run again finds its moved files and passes over them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(error=[place(s, d, copy) for s, d in zip(batch["source"], batch["destination"])])

    moves = plan.filter("dest_path is not null").select(F.col("file_path").alias("source"), F.col("dest_path").alias("destination"))
    return moves.mapInPandas(run, "source string, destination string, error string")
