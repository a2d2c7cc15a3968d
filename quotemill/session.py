"""Bringing this package to the executors where it is not installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their Python finds it by PYTHONPATH anyway."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_quotemill_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quotemill-ship-")) / "quotemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "quotemill").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._quotemill_shipped = True
