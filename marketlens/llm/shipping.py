"""The package's own files go along with the tasks, so that executors need no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import marketlens

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of this application's workers, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(marketlens.__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="marketlens-")), "marketlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
