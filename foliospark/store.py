"""Intermediate tables in the folder that every executor shares.

Long jobs cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading
it back, so a lost executor costs the running stage only. Where that setting is absent (tests on a
local master) a temporary folder takes its place; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: Counter = Counter()
_BEFORE: dict[int, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/foliospark-{uuid.uuid4().hex}/{name}"
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    file_system(spark, path)[0].deleteOnExit(parent)
    return path


@contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of the queries within go when these end; the session's own setting returns with the last of several threads."""
    key = id(spark)
    with _LOCK:
        if not _WRITING[key]:
            _BEFORE[key] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITING[key] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[key] -= 1
            if not _WRITING[key]:
                before = _BEFORE.pop(key)
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_folio_path", None)
        if path:
            delete(table.sparkSession, path)
