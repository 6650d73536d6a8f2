"""Making the package importable in Python workers where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the workers once per context, unless PYTHONPATH already leads there."""
    sc = spark.sparkContext
    here = str(ROOT.parent)
    if here in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_blobsight_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="blobsight-")) / "blobsight.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(target))
    sc._blobsight_shipped = True
