"""Spark session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tracework", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE on; everything else is left to the cluster unless given."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
