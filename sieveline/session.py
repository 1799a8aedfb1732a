"""Sessions with the settings that this library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "sieveline", **conf: str) -> SparkSession:
    """UTC, adaptive execution; further settings by keyword with ``__`` for the dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
