"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package as a zip through Spark's own file server, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        handle, name = tempfile.mkstemp(prefix="grainmill-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, Path(top.name) / path.relative_to(top))
        spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
