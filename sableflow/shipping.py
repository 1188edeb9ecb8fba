"""Makes the package importable for Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def found_by_workers(spark: SparkSession) -> bool:
    """Through PYTHONPATH, or in local mode through the working directory that workers inherit."""
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return True
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster") and Path.cwd() == _ROOT


def ship(spark: SparkSession) -> None:
    """Hands a zip of the package to all executors, once per application, unless they find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _SENT or found_by_workers(spark):
        return
    path = Path(tempfile.mkdtemp(prefix="sableflow-")) / "sableflow.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "sableflow").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
