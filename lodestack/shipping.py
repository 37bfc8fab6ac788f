"""Makes this package importable on executors, wherever the driver runs from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestack_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestack"), "lodestack_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lodestack", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._lodestack_shipped = True
