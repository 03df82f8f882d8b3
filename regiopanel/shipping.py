"""This package on every executor: a zip that Spark distributes, for clusters where it isn't installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this application import this package, once. Operators with Python tasks call it themselves."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="regiopanel-")  # the driver's; Spark sends the file on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    place = os.path.join(folder, "regiopanel.zip")
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(place)
    _SHIPPED.add(app)
