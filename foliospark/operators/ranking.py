"""Ranks and running sums within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize


def running_sum(df: DataFrame, group: list[str], order: list[Column | str], name: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` (1 by default) over the rows of the same group up to each row, in order.

    Rows are sorted in ranges, written, and summed within each range; a range that begins inside a group adds
    what the ranges before have of it. There are at most as many of these carries as ranges. ``order`` should
    tell rows apart; equal ones stay together.
    """
    keys = [*(F.col(c) for c in group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    weighted = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    placed = materialize(weighted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy(*group, "_part").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.withColumn("_carry", F.sum("_sum").over(earlier)).filter("_carry is not null")
    carries = carries.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_part").alias("_p"), "_carry")
    met = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        met = met & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_sum", F.sum("_w").over(within)).join(F.broadcast(carries), met, "left")
    return summed.select(*df.columns, (F.col("_sum") + F.coalesce("_carry", F.lit(0))).alias(name))
