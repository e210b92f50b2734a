"""The session the engine expects: adaptive execution, civil time of Japan, Arrow transfer."""

from __future__ import annotations

from pyspark.sql import SparkSession

TIME_ZONE = "Asia/Tokyo"


def session(name: str = "gleanery", **conf: str) -> SparkSession:
    """A session builder with the engine's defaults; ``conf`` overrides them, with ``__`` for dots."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": TIME_ZONE,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
