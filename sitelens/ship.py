"""Hands this package to the executors of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, *modules: str) -> None:
    """Send the package, and single ``modules`` files, to all executors; once a session.

    Tasks unpickle functions by module name, so a cluster where the package is not
    installed needs its files. Spark serves them from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="sitelens-")  # Spark reads the file until the session ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "sitelens-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, root))
        for name in modules:
            out.write(name, os.path.basename(name))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
