"""The Spark session of this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app_name: str = "waymark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master, memory and partitions come from the cluster or `conf`."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
