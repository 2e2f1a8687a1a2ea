"""The template table as a versioned table: learning, hits, ageing and imports as commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import templates as T
from ..plans.classify import learn_from
from ..store import materialize
from .versioned import VersionConflict, VersionedTable

ATTEMPTS = 20


class TemplateStore(VersionedTable):
    """Rows change by learning only; hit_count and last_hit_at are counters, so commits of hits need no order."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, T.TEMPLATE, "fingerprint", {"hit_count": "sum", "last_hit_at": "max"})

    def _retry(self, step):
        """Take a step that reads the newest version again, if another commit came first."""
        for _ in range(ATTEMPTS):
            try:
                return step(self.manifest()["version"])
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.root}: other commits came first {ATTEMPTS} times")

    def record(self, results: DataFrame, now: Column, stats: dict[str, float], batch: int | None = None) -> int:
        """Learn from the results of a batch, count its hits, and add its numbers of queries and hits to the totals.

        results: columns of ``classify``, written before, as they are read again when another commit came first.
        A template of the batch's own learning has its first confirmations counted, not its first answer.
        """

        def step(version: int) -> int:
            before = self.read(version)
            answered = results.filter("source = 'llm' and is_valid").select("fingerprint").distinct()
            touched = before.join(answered, "fingerprint", "left_semi").select(*before.columns)
            learned = learn_from(touched, results, now)
            old = touched.select("fingerprint", F.col("hit_count").alias("_old"), "confidence", "doc_category")
            known = learned.join(old.withColumnRenamed("confidence", "_confidence").withColumnRenamed("doc_category", "_category"), "fingerprint", "left")
            grown = (F.col("hit_count") - F.coalesce("_old", F.lit(0))).alias("hit_count")
            confirmed = known.select("fingerprint", grown, F.when(grown > 0, now).alias("last_hit_at")).filter("hit_count > 0")
            served = results.filter("tier is not null").groupBy(F.col("template").alias("fingerprint")).agg(F.count("*").alias("hit_count")).withColumn("last_hit_at", now)
            counts = confirmed.unionByName(served).groupBy("fingerprint").agg(F.sum("hit_count").alias("hit_count"), F.max("last_hit_at").alias("last_hit_at"))
            changed = known.filter("_old is null or confidence <> _confidence or not (doc_category <=> _category)").select(*learned.columns)
            return self.commit(rows=changed, counts=counts, stats=stats, batch=batch, expect=version)

        return self._retry(step)

    def age_out(self, now: Column, days: int = 90) -> int:
        """Delete templates older than ``days``; returns how many went."""

        def step(version: int) -> int:
            before = self.read(version)
            old = before.join(T.age_out(before, now, days).select("fingerprint"), "fingerprint", "left_anti").select("fingerprint")
            n = old.count()
            if n:
                self.commit(deletes=old, expect=version)
            return n

        return self._retry(step)

    def import_new(self, given: DataFrame) -> int:
        """Add templates whose fingerprint is new; returns how many were."""

        def step(version: int) -> int:
            before = self.read(version)
            full = given.select(*(F.col(c) if c in given.columns else F.lit(None).cast(t).alias(c) for c, t in self.types.items()))
            merged = T.import_templates(before, full).join(before.select("fingerprint"), "fingerprint", "left_anti").select(*before.columns)
            merged = materialize(merged, "imports")  # counted and written in two parts
            n = merged.count()
            if n:
                self.commit(rows=merged, counts=merged.select("fingerprint", "hit_count", "last_hit_at"), expect=version)
            return n

        return self._retry(step)

    def totals(self) -> dict[str, float]:
        """total_queries, total_hits and hit_rate over all commits."""
        stats = self.manifest()["stats"]
        queries, hits = int(stats.get("queries", 0)), int(stats.get("hits", 0))
        return {"total_queries": queries, "total_hits": hits, "hit_rate": hits / queries if queries else 0.0}

    def tidy(self, most_changes: int, keep: int = 2, grace: float = 3600.0) -> None:
        """Compact once there are many changes, and remove what no kept version names."""
        if self.changes() >= most_changes:
            self.compact()
            self.vacuum(keep, grace)
