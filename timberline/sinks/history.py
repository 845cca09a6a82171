"""History of reports as a Parquet table partitioned by log type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_LIMIT = 200
# fixed values: summary figures kept in the history
KEPT = {"total_entries": "bigint", "total_requests": "bigint", "health": "string", "error_rate": "double", "p95": "double"}


def history_rows(summary: DataFrame, bookkeeping: DataFrame, log_type: str, log_type_label: str,
                 label: str, saved_at: Column) -> DataFrame:
    """One history row of a report: id, time, label, type, kept figures, line totals, the whole summary as JSON."""
    kept = [(F.col(n) if n in summary.columns else F.lit(None)).cast(t).alias(n) for n, t in KEPT.items()]
    whole = F.to_json(F.struct(*summary.columns)).alias("summary_json")
    row = summary.select(*kept, whole).crossJoin(F.broadcast(bookkeeping.select("total_lines", "parsed")))
    return row.select(
        F.expr("uuid()").alias("id"), saved_at.alias("saved_at"), F.lit(label).alias("label"),
        F.lit(log_type).alias("log_type"), F.lit(log_type_label).alias("log_type_label"),
        *KEPT, "total_lines", "parsed", "summary_json")


def save(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("log_type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_reports(history: DataFrame, query: str = "", log_type: str = "all", limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest first, by type and by text in label or type; the limit is the feature."""
    rows = history if log_type in ("", "all") else history.where(F.col("log_type") == log_type)
    if query:
        text = F.lower(F.concat_ws(" ", "label", "log_type_label", "log_type"))
        rows = rows.where(F.contains(text, F.lit(query.lower())))
    return rows.orderBy(F.col("saved_at").desc(), "id").limit(limit)
