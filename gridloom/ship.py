"""Makes this package importable by the executors' Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's modules to the session once (Spark serves it to every executor)."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    here = Path(__file__).resolve().parent
    d = tempfile.mkdtemp(prefix="gridloom-ship-")
    with zipfile.ZipFile(z := os.path.join(d, "gridloom_modules.zip"), "w") as f:
        for p in sorted(here.rglob("*.py")):
            f.write(p, p.relative_to(here.parent))
    sc.addPyFile(z)
    _DONE.add(sc.applicationId)
