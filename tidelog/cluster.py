"""Sends the package's code to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that workers import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidelog-code-")  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tidelog_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tidelog_shipped = True
