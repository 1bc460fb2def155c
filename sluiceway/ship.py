"""Gives this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each Spark application, as a zip file."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sluiceway-")) / "sluiceway.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, str(path.relative_to(here.parent)))
    context.addPyFile(str(archive))
    _DONE.add(context.applicationId)
