"""Session settings the package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "wattframe",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with UTC times and adaptive execution.

    ``master`` is left to the cluster manager when it is not given.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
