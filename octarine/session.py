"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "octarine", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; what the caller or the cluster sets comes first."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
