"""Sends this package to the executors, for sessions whose Python workers cannot import it themselves."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a zip, fetched from the driver by every executor."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lacuna-code-"), "lacuna_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lacuna", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(target)
    _sent.add(app)


def shipped(query):
    """The query, with the package sent before it runs."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
