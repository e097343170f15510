"""The package for Python workers that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the workers of ``spark``, once for each application; Spark carries the file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="stmtlog-code-"), "stmtlog_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((root / "stmtlog").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(path)
