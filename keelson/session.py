"""Session with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "keelson", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. ``conf`` wins over the defaults.

    Join sides are never hinted by this package: Spark broadcasts a side only when its
    measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a
    sort-merge join with adaptive skew splitting above it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
