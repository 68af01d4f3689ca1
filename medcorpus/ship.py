"""Sends this package to the executors, so that its functions can be imported where tasks run."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's files, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # Spark's file server hands it to the executors; only the driver reads this folder
    path = Path(tempfile.mkdtemp(prefix="medcorpus-")) / "medcorpus.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
