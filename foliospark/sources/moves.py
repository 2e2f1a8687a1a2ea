"""Moving files by a plan, so that a run cut short and repeated loses, doubles and overwrites nothing.

Spark tasks carry the moves out on paths that they all share. A destination is created only if nothing is
there: on one file system by a hard link before the source goes, between two by a copy under a temporary
name that is then linked. Each task notes what it is about to do and what came of it in files of the
journal; the commit of the write names them. A repeated move finds its own work: a destination that is the
source's twin, or the same bytes, lets the source go; a source that is gone leaves its destination alone.
"""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "foliospark_moves"
CHUNK = 500


def _publish(made: str, destination: str) -> bool:
    """Give a finished file its name, unless the name is taken."""
    try:
        os.link(made, destination)
        return True
    except FileExistsError:
        return False


def _same(a: str, b: str) -> bool:
    return os.path.samefile(a, b) or (os.path.getsize(a) == os.path.getsize(b) and filecmp.cmp(a, b, shallow=False))


def _copied(source: str, destination: str) -> bool:
    made = os.path.join(os.path.dirname(destination), f".{uuid.uuid4().hex}.part")
    try:
        shutil.copy2(source, made)
        with open(made, "rb") as f:
            os.fsync(f.fileno())
        return _publish(made, destination)
    finally:
        if os.path.exists(made):
            os.unlink(made)


def place(source: str, destination: str, copy: bool = False) -> str | None:
    """Move or copy one file; returns what went wrong, or nothing. Nothing at the destination is ever replaced."""
    try:
        os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
        if not os.path.exists(source):
            return None if os.path.exists(destination) and not copy else "File not found (already moved?)"
        try:
            made = _copied(source, destination) if copy else _publish(source, destination)
        except OSError as e:
            if copy or isinstance(e, FileNotFoundError):
                raise
            made = _copied(source, destination)  # another file system, or one without links
        if not made and not _same(source, destination):
            return "the destination exists"
        if not copy:
            os.unlink(source)
        return None
    except OSError as e:
        return str(e)


def write_text(path: str, text: str) -> str | None:
    """Create a small file as a whole; one of the same content may be there already."""
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        made = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.part")
        with open(made, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            if _publish(made, path) or filecmp.cmp(made, path, shallow=False):
                return None
            return "the destination of the result exists"
        finally:
            os.unlink(made)
    except OSError as e:
        return str(e)


@dataclass
class Noted(WriterCommitMessage):
    part: str
    done: int
    failed: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.journal, self.copy = options["journal"].rstrip("/"), options.get("copy", "false").lower() == "true"
        self.columns = schema.names

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(f"{self.journal}/parts", exist_ok=True)
        name = f"parts/{uuid.uuid4().hex}.jsonl"
        done = failed = 0
        with open(f"{self.journal}/{name}", "a", encoding="utf-8") as log:

            def note(kind: str, rows: list[dict]) -> None:
                log.writelines(json.dumps({"kind": kind} | r, ensure_ascii=False) + "\n" for r in rows)
                log.flush()
                os.fsync(log.fileno())

            def carry_out(chunk: list[dict]) -> None:
                nonlocal done, failed
                note("intent", [{"source": r["source"], "destination": r["destination"]} for r in chunk])
                out = []
                for r in chunk:
                    error = write_text(r["result_path"], r["result"]) if r.get("result_path") else None
                    error = error or place(r["source"], r["destination"], self.copy)
                    out.append({"source": r["source"], "destination": r["destination"], "error": error})
                    done, failed = done + (error is None), failed + (error is not None)
                note("outcome", out)

            chunk: list[dict] = []
            for row in iterator:
                chunk.append(dict(zip(self.columns, row)))
                if len(chunk) == CHUNK:
                    carry_out(chunk)
                    chunk = []
            if chunk:
                carry_out(chunk)
        return Noted(name, done, failed)

    def _close(self, kind: str, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        entry = {"kind": kind, "at": time.time(), "done": sum(m.done for m in parts), "failed": sum(m.failed for m in parts), "parts": [m.part for m in parts]}
        os.makedirs(self.journal, exist_ok=True)
        write_text(f"{self.journal}/{kind}-{uuid.uuid4().hex}.json", json.dumps(entry))

    def commit(self, messages: list) -> None:
        self._close("commit", messages)

    def abort(self, messages: list) -> None:
        """What was moved stays moved; the same plan written again finishes it."""
        self._close("abort", messages)


class Moves(DataSource):
    """Sink of rows (source, destination, and optionally result_path, result) with the options journal and copy."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema)


def move_files_journaled(plan: DataFrame, journal: str, copy: bool = False, results: str | None = None) -> DataFrame:
    """Carry out a plan's moves and return source, destination, error of each, as the journal's last outcomes have them.

    With ``results`` every file that ends in success also leaves ``<its name>.json`` with the row of the
    plan in that folder, numbered like its destination, before the file itself moves.
    """
    spark = plan.sparkSession
    spark.dataSource.register(Moves)
    moves = plan.filter("dest_path is not null").select(F.col("file_path").alias("source"), F.col("dest_path").alias("destination"), F.to_json(F.struct(*plan.columns)).alias("result"), "status")
    columns = ["source", "destination"]
    if results is not None:
        name = F.regexp_replace(F.regexp_replace("destination", "^.*/", ""), r"\.[^./]*$", "")
        # of files with one name in different folders each takes the digest of its destination along
        shared = F.concat(F.lit(results.rstrip("/") + "/"), name, F.lit("-"), F.substring(F.sha2("destination", 256), 1, 12), F.lit(".json"))
        moves = moves.withColumn("result_path", F.when(F.col("status") == "success", shared))
        columns += ["result_path", "result"]
    moves.select(*columns).write.format(FORMAT).option("journal", journal).option("copy", str(copy).lower()).mode("append").save()
    return outcomes(spark, journal).join(moves.select("source", "destination"), ["source", "destination"], "left_semi")


def outcomes(spark, journal: str) -> DataFrame:
    """source, destination, error of the moves that the commits of a journal name; a move that worked once has worked."""
    commits = spark.read.schema("kind string, parts array<string>").json(f"file://{os.path.abspath(journal)}").filter("kind = 'commit'")
    named = commits.select(F.explode("parts").alias("part"))
    lines = spark.read.schema("kind string, source string, destination string, error string").json(f"file://{os.path.abspath(journal)}/parts").select("*", "_metadata.file_path").filter("kind = 'outcome'")
    mine = lines.join(named, F.regexp_extract("file_path", "(parts/[^/]+)$", 1) == F.col("part"), "left_semi")
    return mine.groupBy("source", "destination").agg(F.min(F.coalesce("error", F.lit(""))).alias("error")).withColumn("error", F.nullif("error", F.lit("")))
