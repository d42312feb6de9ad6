"""Sends this package's Python files to the executors, for functions that run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; executors that have the package installed already read the same files."""
    sc = spark.sparkContext
    if getattr(sc, "_allelo_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="allelo-")) / "allelo_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._allelo_shipped = True
