"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only where driver and executors are one process a local folder is made if
    the setting is missing; on a cluster executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/timberline-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to Parquet once and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
