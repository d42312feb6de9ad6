"""Everything but the document operators works without their folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
import sys
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert e.queries()["q03_allele_counts"](spark, sys.argv[2]).count() >= 0
print("works")
"""


def test_without_the_document_operators(tmp_path, sf):
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{int(keep_pipeline)}"
        shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        env = {**os.environ, "PYTHONPATH": str(copy)}
        got = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), sf], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert "works" in got.stdout, got.stderr[-2000:]
