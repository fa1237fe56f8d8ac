"""Hand the package to the executors, so that a cluster needs no installation of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT = "codeatlas.package.sent"


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if spark.conf.get(_SENT, "") == context.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if root.endswith(".zip/codeatlas"):  # already running from such a zip
        return
    path = os.path.join(tempfile.mkdtemp(prefix="codeatlas-package-"), "codeatlas.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    file.write(full, os.path.join("codeatlas", os.path.relpath(full, root)))
    context.addPyFile(path)
    spark.conf.set(_SENT, context.applicationId)
