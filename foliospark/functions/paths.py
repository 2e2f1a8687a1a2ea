"""Path components, destinations and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def path_component(name: Column) -> Column:
    """A safe folder name of at most 50 characters; 'unknown' if nothing is left."""
    clean = trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*]', "_"), "_+", "_"))
    clean = F.regexp_replace(F.regexp_replace(clean, " ", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(clean, 1, 50), "_+$", "")
    return F.when(cut == "", "unknown").otherwise(cut)


def path_hash(path: Column) -> Column:
    return F.sha2(F.lower(F.regexp_replace(path, r"\\", "/")), 256)


def destination(root: Column, parts: list[Column], year: Column, filename: Column) -> Column:
    """root/parts/year/filename, each part made safe."""
    return F.concat_ws("/", root, *(path_component(p) for p in parts), F.coalesce(year.cast("string"), F.lit("unknown")), filename)
