"""Destinations that no two files and no file on disk share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import exists
from .ranking import running_sum

_EXTENSION = r"(\.[^./]*)$"
_NUMBERED = r"^(.*)_([1-9][0-9]{0,17})(\.[^./]*)?$"


def existing_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file below a folder, without reading any; no rows if the folder is missing."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def _split(path: Column) -> tuple[Column, Column]:
    return F.regexp_replace(path, _EXTENSION, ""), F.regexp_extract(path, _EXTENSION, 1)


def resolve_conflicts(df: DataFrame, dest_col: str, order_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows with destinations of their own: the first of each destination keeps it unless a file is there, others get _1, _2 and so on.

    A number is free if no existing file (``path``) and no row that keeps its destination has that name. Numbered
    names of different destinations differ, as each ends in one number, so numbering is done at once: the r-th
    row takes the r-th number that is free. Rows order by ``order_col``, then by their content. There is no
    limit to the numbers. Rows without a destination stay as they are.
    """
    columns = df.columns
    there = (df.sparkSession.createDataFrame([], "path string") if existing is None else existing).select(F.col("path").alias("_path")).distinct()
    tie = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes))
    placed = running_sum(df.filter(F.col(dest_col).isNotNull()), [dest_col], [order_col, tie], "_nth")
    placed = placed.join(there, F.col(dest_col) == F.col("_path"), "left")
    placed = placed.withColumn("_there", F.col("_path").isNotNull()).drop("_path")
    keeps = (F.col("_nth") == 1) & ~F.col("_there")
    kept, others = placed.filter(keeps), placed.filter(~keeps)
    # the numbers that names of a destination's form have taken, and how many free ones lie below each
    names = kept.select(F.col(dest_col).alias("_path")).unionByName(there)
    numbers = names.filter(F.col("_path").rlike(_NUMBERED)).select(
        F.concat(F.regexp_extract("_path", _NUMBERED, 1), F.regexp_extract("_path", _NUMBERED, 3)).alias("_dest"), F.regexp_extract("_path", _NUMBERED, 2).cast("long").alias("_number")
    )
    wanted = others.select(F.col(dest_col).alias("_dest")).distinct()
    taken = running_sum(numbers.join(wanted, "_dest", "left_semi").distinct(), ["_dest"], ["_number"], "_i")
    rank = F.when(F.col("_there"), F.col("_nth")).otherwise(F.col("_nth") - 1)
    events = others.withColumns({"_dest": F.col(dest_col), "_key": rank, "_taken": F.lit(0)}).unionByName(
        taken.select("_dest", (F.col("_number") - F.col("_i")).alias("_key"), F.lit(1).alias("_taken")), allowMissingColumns=True
    )
    # of equal keys the row comes first: a taken number with as many free ones below lies above the row's own
    counted = running_sum(events, ["_dest"], ["_key", "_taken"], "_skipped", F.col("_taken")).filter("_taken = 0")
    stem, extension = _split(F.col(dest_col))
    numbered = counted.withColumn(dest_col, F.concat(stem, F.lit("_"), (F.col("_key") + F.col("_skipped")).cast("string"), extension))
    return kept.select(*columns).unionByName(numbered.select(*columns)).unionByName(df.filter(F.col(dest_col).isNull()))
