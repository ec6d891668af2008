"""A folder for intermediate tables where the session names none."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def name_folder(spark: SparkSession) -> SparkSession:
    """Keep the session's ``spark.checkpoint.dir``; a local master without one gets a temporary folder.

    On a cluster such a folder would exist on one machine only, so none is made there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graph-queries-"))
    return spark
