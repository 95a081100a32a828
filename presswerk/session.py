"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "presswerk", **conf: str) -> SparkSession:
    """A session in UTC with ANSI checks and adaptive execution; ``conf`` overrides."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()
