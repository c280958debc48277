"""Sending this package to the executors' Python path, for operators whose tasks run Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: rows of a batch that goes to Python and back; Spark's own 10,000 rows of texts or pages take hundreds of megabytes a
#: task, in the JVM's buffers and in Python
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once, and keep batches small unless the session
    has a size of its own."""
    key, default, few = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, few)
    sc = spark.sparkContext
    if getattr(sc, "_gavelworks_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "gavelworks_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("gavelworks", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._gavelworks_shipped = True
