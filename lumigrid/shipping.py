"""Puts this package on the executors' path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the application's files unless PYTHONPATH already has them; once per application."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="lumigrid-ship-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := os.path.join(folder, "lumigrid_ship.zip"), "w") as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
