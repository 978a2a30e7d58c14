"""Session settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "strataweave", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC times and adaptive plans; settings override (underscores stand for dots)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(name).config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()
