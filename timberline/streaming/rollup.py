"""Hourly rollup of access logs as their files arrive.

A file source feeds the access parser; entries are folded per hour of their
real time to value counts (see :mod:`timberline.operators.stats`), the same states that the
store keeps. Counts of an hour stay open until the watermark has passed it, so a late file
corrects its hours; entries behind the watermark, and those without a full time, are left out.

Each micro-batch writes the states that it changed, whole, into a folder of its
own number. A batch that is repeated after a failure writes the same folder
again, and readers take the latest state of each value, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.functions.clock import event_instant
from timberline.operators import stats
from timberline.operators.entries import entries
from timberline.operators.once import once
from timberline.operators.parse_web import parse_access

_MEASURES = ("_c", "_valued", "errors", "total_bytes")


def _states(lines: DataFrame, late: str) -> DataFrame:
    e = once(entries(parse_access(lines)).select("zone", "response_time", "status", "bytes", "timestamp"), _stamp=F.col("timestamp"))
    timed = once(e, instant=event_instant(F.col("_stamp"), F.col("zone")).cast("timestamp"))
    value = F.col("response_time").cast("double")
    return (
        timed.where(F.col("instant").isNotNull()).withWatermark("instant", late)
        .select("instant", value.alias("_v"), stats.bucket(value).alias("_b"), "status", "bytes")
        .groupBy(F.window("instant", "1 hour"), "_b", "_v").agg(
            F.count("*").alias("_c"), F.count("_v").alias("_valued"), F.count_if(F.col("status") >= 400).alias("errors"),
            F.sum(F.col("bytes").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total_bytes"))
        .select(F.col("window.start").alias("hour_start"), "_b", "_v", *_MEASURES)
    )


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "2 hours", files_per_batch: int = 1_000) -> StreamingQuery:
    """Take in all files that ``folder`` (a path or a glob) has by now and stop; call again for later ones.

    ``out`` and ``checkpoint`` are folders that driver and executors share.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    lines = raw.select(F.col("_metadata.file_path").alias("source"), F.lit(0).cast("bigint").alias("line_no"), F.make_valid_utf8("value").alias("value"))

    def save(states: DataFrame, number: int) -> None:
        states.write.mode("overwrite").parquet(f"{out}/number={number}")

    return _states(lines, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(save).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The states as they stand now, for :mod:`timberline.plans.hours`: hours and days are in UTC."""
    held = spark.read.parquet(out)
    latest = held.groupBy("hour_start", "_b", "_v").agg(F.max_by(F.struct(*_MEASURES), "number").alias("s"))
    hour = F.date_format("hour_start", "yyyy-MM-dd HH:00")
    return latest.select(F.lit(None).cast("string").alias("source"), F.left(hour, F.lit(10)).alias("day"), hour.alias("hour"), "_b", "_v", "s.*")
