"""Session settings the engine wants; every one can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "512",
}


def session(app: str = "callweight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; loops hold many small stages, so on one machine few shuffle
    partitions are faster, on a cluster AQE coalesces a larger number."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
