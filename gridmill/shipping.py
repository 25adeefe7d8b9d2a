"""Bring this package to the Python workers of a session that would not find it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process; ``local-cluster`` is not."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _found_anyway() -> bool:
    """Workers of a local session inherit PYTHONPATH, and look in the folder they start in."""
    root = str(_PACKAGE.parent)
    return root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each application; a local session's may be on the path.

    What the driver's own path holds says nothing about other machines. Spark serves the archive from the driver, to executors that start later too.
    """
    app = spark.sparkContext.applicationId
    if app in _sent or (is_local(spark) and _found_anyway()):
        return
    folder = tempfile.mkdtemp(prefix="gridmill-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/gridmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
