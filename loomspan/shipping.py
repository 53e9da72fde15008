"""Sends the package to Python workers that would not find it."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's files, once for each application.

    Not done where the workers' path has it: on PYTHONPATH or installed.
    """
    sc = spark.sparkContext
    home = os.path.dirname(_PACKAGE)
    there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in there or "site-packages" in home or getattr(sc, "_loomspan_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomspan-"), "loomspan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, home))
    sc.addPyFile(path)
    sc._loomspan_shipped = True
