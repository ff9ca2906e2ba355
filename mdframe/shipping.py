"""Giving Python workers this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, unless PYTHONPATH already leads them to it."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_mdframe_shipped", False):
        return
    with tempfile.TemporaryDirectory() as d:
        tree = os.path.join(d, "tree")
        shutil.copytree(package, os.path.join(tree, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="mdframe-code-"), "mdframe"), "zip", tree)
    context.addPyFile(archive)
    context._mdframe_shipped = True
