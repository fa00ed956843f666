"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins. Partition counts are left to adaptive execution; everything can be overridden."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()
