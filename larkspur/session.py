"""Sessions: the package's way to the executors' Python."""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors, once a context; workers then import it wherever they run."""
    context = spark.sparkContext
    if context not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="larkspur-source-")
        shutil.copytree(here, f"{folder}/larkspur", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/larkspur", "zip", folder, "larkspur"))
        shutil.rmtree(f"{folder}/larkspur")
        _shipped.add(context)
    return spark
