"""A session with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "barquality", master: str | None = None, **options: str) -> SparkSession:
    """UTC session time, ANSI mode and adaptive execution; everything else as configured."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }
    for key, value in (fixed | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
