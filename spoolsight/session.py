"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's own modules to the executors, once per application.

    Python functions that run in tasks refer to these modules by name. A cluster deployment would name the package in
    ``--py-files``; this does the same for a session that was started without it.
    """
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spoolsight-code-")) / "spoolsight-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(key)
