"""Timelines as tables clustered by time, with the rank of each entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_clustered(rows: DataFrame, keys: Sequence[str], path: str) -> None:
    """Rows cut into ranges of the keys, each range sorted in files of its own.

    The keys must name a row (time, place of the source, line), so that equal
    times lie in one order only. No task holds more than a range.
    """
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def read_ranked(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The clustered rows with ``rank``, from 1 over all of them.

    A row's rank is its place in its file and the rows of all files before:
    one small row per file, read from the keys alone.
    """
    rows = spark.read.parquet(path)
    held = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"), F.min(F.struct(*keys)).alias("_low"))
    before = W.orderBy("_low").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    located = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return located.join(starts, "_file").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_file", "_at", "_start")
