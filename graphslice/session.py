"""A Spark session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings a cluster's own spark-defaults may override.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "graphslice", **settings: str) -> SparkSession:
    """``build_session(master="local[8]")``; dots in setting names as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    master = settings.pop("master", None)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
