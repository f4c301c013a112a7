"""This package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Ship this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "spindle_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "spindle")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
