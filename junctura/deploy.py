"""Bring this package to the executors of a session that was started without it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_junctura_shipped", False):
        return
    here = Path(__file__).parent
    where = tempfile.mkdtemp(prefix="spark-junctura-py-")
    shutil.copytree(here, os.path.join(where, "src", here.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(where, here.name), "zip", os.path.join(where, "src")))
    sc._junctura_shipped = True
