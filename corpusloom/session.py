"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), f"{root.name}.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
