"""The library without the training-data subpackage, its tests and the pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) > 50
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert e.entry(spark).count() >= 0
for name in ("fingerprint_similarity", "organize_paths"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").limit(5).count() >= 0
print("all is well")
"""


def test_the_rest_works_alone(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/foliospark", copy / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    assert not (copy / "foliospark" / "llm").exists()
    out = subprocess.run([sys.executable, "-c", RUN], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert "all is well" in out.stdout, out.stderr[-3000:]
