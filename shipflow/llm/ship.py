"""The package on the executors, for code that runs in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give workers this package through Spark, once per application, wherever it is installed or not."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="shipflow-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = Path(folder, "package")
        shutil.copytree(PACKAGE, copy / PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", copy))
        _shipped.add(context.applicationId)
    return spark
