"""Make this package importable on the executors, and keep what goes to their Python workers small."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Spark's setting for the bytes of rows handed to a Python worker at once, its default, and what long texts and sounds leave memory for.
ARROW_BYTES, DEFAULT, SMALLER = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application; functions that run there are pickled by reference to it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="kinfolk-code-"), "kinfolk.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """For an application's own session: rows go to Python workers in smaller batches, unless the session asks for a size of its own."""
    if spark.conf.get(ARROW_BYTES).lower().rstrip("b") == str(DEFAULT):
        spark.conf.set(ARROW_BYTES, str(SMALLER))
