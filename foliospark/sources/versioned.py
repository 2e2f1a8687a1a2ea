"""Keyed tables with consistent versions, kept as Parquet folders below manifests.

A version is one manifest: the folder of a whole snapshot, and the folders of the changes since. A commit
writes its folders first and then publishes the next manifest under a name that must not exist yet, so
readers see the version before or the version after, never a part, and a writer that dies in between
leaves folders that no manifest names. Changes are rows (the newest of a key counts), counters (added up,
so commits of hits need no order) and deletions (of what was there until then). Every commit may carry the
number of the batch it belongs to; a table tells the last one, so a batch that runs again is passed over.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import exists, file_system

SEQ = "_seq"
KEEP, GRACE_SECONDS = 2, 3600.0


class VersionConflict(RuntimeError):
    """Another writer has published the version that this commit was to be."""


class VersionedTable:
    """A table below ``root``: ``schema`` as DDL, its ``key``, and ``counters``: column to 'sum' or 'max' over all commits."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, counters: dict[str, str] | None = None):
        self.spark, self.root, self.schema, self.key, self.counters = spark, root.rstrip("/"), schema, key, counters or {}
        self.types = dict(c.strip().split(" ", 1) for c in schema.split(","))

    # --- versions

    def versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.root}/versions")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of, by default the newest; before the first one an empty table."""
        known = self.versions()
        if version == 0 or version is None and not known:
            return {"version": 0, "base": None, "rows": [], "counts": [], "deletes": [], "batch": -1, "stats": {}}
        fs, path = file_system(self.spark, f"{self.root}/versions/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last_batch(self) -> int:
        return self.manifest()["batch"]

    def _publish(self, manifest: dict) -> None:
        name = f"{self.root}/versions/{manifest['version']:012d}.json"
        fs, final = file_system(self.spark, name)
        fs.mkdirs(final.getParent())
        _, made = file_system(self.spark, f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace the file, a link does not
                os.link(made.toUri().getPath(), final.toUri().getPath())
                return
            jvm = self.spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(made, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if exists(self.spark, name):
                raise VersionConflict(name) from e
            raise
        finally:
            fs.delete(made, False)

    # --- writing

    def _write(self, df: DataFrame, columns: dict[str, str], version: int) -> str:
        path = f"{self.root}/data/{version:012d}-{uuid.uuid4().hex}"
        df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()), F.lit(version).alias(SEQ)).write.parquet(path)
        return path

    def commit(
        self, rows: DataFrame | None = None, counts: DataFrame | None = None, deletes: DataFrame | None = None, batch: int | None = None,
        stats: dict[str, float] | None = None, expect: int | None = None,
    ) -> int:
        """Publish changes as the next version and return its number.

        ``rows`` has the columns of the table (counters are left to ``counts``: key and counters), ``deletes``
        the key. ``stats`` are added to those of the version before. With ``expect`` the version before must
        have that number. Raises VersionConflict if another commit came first.
        """
        before = self.manifest()
        if expect is not None and before["version"] != expect:
            raise VersionConflict(f"{self.root}: version {before['version']} instead of {expect}")
        version = before["version"] + 1
        new = before | {"version": version, "at": time.time()}
        plain = {c: t for c, t in self.types.items() if c not in self.counters}
        counted = {self.key: self.types[self.key]} | {c: self.types[c] for c in self.counters}
        for kind, df, columns in (("rows", rows, plain), ("counts", counts, counted), ("deletes", deletes, {self.key: self.types[self.key]})):
            if df is not None:
                new[kind] = [*before[kind], self._write(df, columns, version)]
        if batch is not None:
            new["batch"] = batch
        new["stats"] = {k: before["stats"].get(k, 0) + (stats or {}).get(k, 0) for k in {*before["stats"], *(stats or {})}}
        self._publish(new)
        return version

    def compact(self) -> int:
        """The newest version as one snapshot, as a version of its own."""
        before = self.manifest()
        version = before["version"] + 1
        path = self._write(self.read(before["version"]), self.types, version)
        self._publish(before | {"version": version, "base": path, "rows": [], "counts": [], "deletes": [], "at": time.time()})
        return version

    def changes(self) -> int:
        m = self.manifest()
        return max(len(m[k]) for k in ("rows", "counts", "deletes"))

    def vacuum(self, keep: int = KEEP, grace: float = GRACE_SECONDS) -> list[str]:
        """Delete all but the ``keep`` newest manifests, and folders that none of these name and that are older than ``grace`` seconds.

        The grace is for commits that have written but not published yet, and for readers of older versions.
        """
        known = self.versions()
        held = [self.manifest(v) for v in known[-keep:]]
        used = {p.rsplit("/", 1)[1] for m in held for p in [m["base"], *m["rows"], *m["counts"], *m["deletes"]] if p}
        gone = []
        fs, folder = file_system(self.spark, f"{self.root}/data")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f.getPath().getName()
            if name not in used and time.time() - f.getModificationTime() / 1000 >= grace:
                fs.delete(f.getPath(), True)
                gone.append(name)
        for v in known[:-keep]:
            fs.delete(file_system(self.spark, f"{self.root}/versions/{v:012d}.json")[1], False)
        return gone

    # --- reading

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _load(self, paths: list[str], columns: dict[str, str]) -> DataFrame | None:
        schema = ", ".join(f"`{c}` {t}" for c, t in columns.items()) + f", {SEQ} bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default."""
        m = self.manifest(version)
        whole = [m["base"]] if m["base"] else []
        if whole and not (m["rows"] or m["counts"] or m["deletes"]):
            return self._load(whole, self.types).drop(SEQ)
        plain = {c: t for c, t in self.types.items() if c not in self.counters}
        rows = self._load(whole + m["rows"], plain)
        if rows is None:
            return self._empty()
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*plain, SEQ), SEQ).alias("_r")).select("_r.*")
        gone = self._load(m["deletes"], {self.key: self.types[self.key]})
        last = None if gone is None else gone.groupBy(self.key).agg(F.max(SEQ).alias("_gone"))

        def alive(df: DataFrame) -> DataFrame:
            if last is None:
                return df
            return df.join(last, self.key, "left").filter(F.col("_gone").isNull() | (F.col(SEQ) > F.col("_gone"))).drop("_gone")

        out = alive(newest).drop(SEQ)
        if self.counters:
            counted = self._load(whole + m["counts"], {self.key: self.types[self.key]} | {c: self.types[c] for c in self.counters})
            if counted is None:
                out = out.select("*", *(self._none(c) for c in self.counters))
            else:
                total = alive(counted).groupBy(self.key).agg(*((F.sum if how == "sum" else F.max)(c).alias(c) for c, how in self.counters.items()))
                out = out.join(total, self.key, "left")
        return out.select(*(self._filled(c) for c in self.types))

    def _none(self, c: str) -> Column:
        return F.lit(None).cast(self.types[c]).alias(c)

    def _filled(self, c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0)) if self.counters.get(c) == "sum" else F.col(c)
        return value.cast(self.types[c]).alias(c)
