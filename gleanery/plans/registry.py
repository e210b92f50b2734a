"""The registry of queries and their SQL, and the folder that queries may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader as a query, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``. Only where everything runs on one
    machine (tests) may the setting be absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/gleanery-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
