"""Routing of classified files to destinations, as a plan that moves nothing by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import destination
from ..operators.free_names import resolve_conflicts


def organize_plan(
    results: DataFrame, output_dir: str, min_confidence: float = 0.7, use_trash: bool = True, by_category: bool = False, existing: DataFrame | None = None,
) -> DataFrame:
    """results(filename, country, doc_type, doc_category, company, year, confidence, is_valid, error) with status, message and dest_path.

    No two rows share a destination, nor does any take the name of an ``existing`` file (``path``).
    """
    low = F.coalesce(F.col("confidence"), F.lit(0.0)) < min_confidence
    bad = ~F.coalesce("is_valid", F.lit(False))
    status = F.when(F.col("error").isNotNull(), "error").when(bad | low, "trash" if use_trash else "skipped").otherwise("success")
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(bad, "Invalid classification").when(low, F.concat(F.lit("Confidence too low: "), F.format_string("%.0f", F.bround(F.col("confidence") * 100, 0)), F.lit("%")))
    parts = [F.col(c) for c in (["country", "doc_category", "doc_type", "company"] if by_category else ["country", "doc_type", "company"])]
    placed = results.withColumns({"status": status, "message": message})
    path = F.when(F.col("status") == "success", destination(F.lit(output_dir), parts, F.col("year"), F.col("filename"))).when(
        F.col("status") == "trash", F.concat_ws("/", F.lit(output_dir), F.lit("unclassified"), F.col("filename"))
    )
    placed = placed.withColumn("dest_path", path)
    return resolve_conflicts(placed, "dest_path", "file_path" if "file_path" in results.columns else "filename", existing)
