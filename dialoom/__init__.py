"""A PySpark-native engine for conversational recommendation data."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, unless PYTHONPATH or spark.submit.pyFiles already does."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get("spark.submit.pyFiles", ""):
        return
    sc = spark.sparkContext
    if getattr(sc, "_dialoom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="dialoom-code-")) / "dialoom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))  # served to executors by the driver
    sc._dialoom_shipped = True
