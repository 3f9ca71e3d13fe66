"""Sessions with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What matters at any size; partition counts and memory belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS and ``extra`` (names with _ for .)."""
    builder = SparkSession.builder.appName("quillspark")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in extra.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
