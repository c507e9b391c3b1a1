"""Spark-native analytics over collections of linked Markdown notes."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the executors once per Spark context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_notegrove_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="notegrove-"), "notegrove.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("notegrove", os.path.relpath(full, top)))
    sc.addPyFile(at)
    sc._notegrove_shipped = True
