"""Bringing this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers.

    Nothing is done where PYTHONPATH already holds it, as on a cluster on which
    it is installed.  Else Spark's own file server distributes an archive.
    """
    top = Path(__file__).resolve().parents[1]
    places = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(top) in [os.path.abspath(p) for p in places if p] or getattr(spark.sparkContext, "_loomline", False):
        return
    archive = Path(tempfile.mkdtemp()) / "loomline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((top / "loomline").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._loomline = True
