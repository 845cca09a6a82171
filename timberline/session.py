"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that hold at any scale. Partition counts and memory belong to the
# cluster: set spark.sql.shuffle.partitions to two or three times the cores.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # both branches of the statistics read one shuffle
    "spark.sql.exchange.reuse": "true",
    # generated methods beyond this size are not compiled by the JVM
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # call sites of single columns are not recorded; plans are built faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app_name: str = "timberline") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b
