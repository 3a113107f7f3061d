"""Named queries over the test tables."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from importlib import import_module

from pyspark.sql import SparkSession

MODULES = (
    "detection_queries",
    "identity_queries",
    "track_queries",
    "field_queries",
    "calibration_queries",
    "telemetry_queries",
    "scoring_queries",
    "stream_queries",
    "source_queries",
)


def load_catalog():
    """Import every query module and return the registry they fill."""
    for name in MODULES:
        import_module(f".{name}", __name__)
    return import_module(".catalog", __name__)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for its Python functions."""
    sc = spark.sparkContext
    if getattr(sc, "_sightline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="sightline-")
    archive = shutil.make_archive(f"{folder}/sightline", "zip", root, "sightline")
    sc.addPyFile(archive)
    sc._sightline_shipped = True


def shipped(query):
    """The query, with the package sent ahead of its first run."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run
