"""Report on syslog and authentication logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.clock import hour_key
from timberline.functions.numeric import percent
from timberline.functions.text import shorten, syslog_fingerprint
from timberline.operators import frequency as fq
from timberline.operators.entries import entries
from timberline.operators.once import once
from timberline.operators.parse_system import trace_sizes
from timberline.operators.positions import indexed_rows
from timberline.plans.app import error_samples
from timberline.plans.common import frequency_chart, hourly, message_chart, share_table
from timberline.plans.options import Options, Output

ERRORS = ("ERROR", "FATAL")


def summary(df: DataFrame, o: Options) -> DataFrame:
    severity = F.col("severity")
    return entries(df, o.exclude).groupBy(*o.by).agg(
        F.count("*").alias("total_entries"),
        F.count_distinct("process").alias("unique_processes"),
        F.count_if("is_auth_failure").alias("auth_failures"),
        F.count_distinct("source_ip").alias("unique_source_ips"),
        F.count_distinct("user").alias("unique_users_targeted"),
        F.count_if((F.col("category") == "kernel") & (severity == "WARN")).alias("kernel_warnings"),
        F.count_if(F.col("trace_line_count") > 0).alias("kernel_trace_blocks"),
        F.coalesce(F.sum("trace_line_count"), F.lit(0).cast("bigint")).alias("kernel_trace_lines"),
        F.count_if(severity.isin(*ERRORS)).alias("error_count"),
        F.count_if(severity == "WARN").alias("warn_count"),
        F.count_if(severity == "DEBUG").alias("debug_count"),
        F.count_distinct("hostname").alias("unique_hostnames"),
        F.count("anomaly_type").alias("total_anomalies"),
        F.count_distinct("anomaly_type").alias("anomaly_types"),
    ).withColumn("auth_failure_rate", percent(F.col("auth_failures"), F.col("total_entries")))


def auth_failures_detail(df: DataFrame, o: Options) -> DataFrame:
    return indexed_rows(entries(df, o.exclude), F.col("is_auth_failure"), {
        "timestamp": F.col("timestamp"), "source_ip": F.col("source_ip"), "user": F.col("user"),
        "message": F.left("message", F.lit(150))}
    ).orderBy("source", "entry_idx").select(*o.by, "timestamp", "source_ip", "user", "message", "entry_idx")


def anomaly_samples(df: DataFrame, o: Options) -> DataFrame:
    """Per anomaly type: count, and detail, message and index of its first entry."""
    rows = indexed_rows(entries(df, o.exclude), F.col("anomaly_type").isNotNull(), {
        "type": F.col("anomaly_type"), "detail": F.col("anomaly_detail"),
        "sample": F.left("message", F.lit(200))})
    first = F.min(F.struct("entry_idx", "detail", "sample"))
    return rows.groupBy(*o.by, "type").agg(first.alias("f"), F.count("*").alias("count")).orderBy(
        *o.by, F.col("f.entry_idx")
    ).select(*o.by, "type", F.col("f.detail").alias("detail"), F.col("f.sample").alias("sample_message"), "count",
             F.col("f.entry_idx").alias("entry_idx"))


def anomaly_fingerprints(df: DataFrame, o: Options) -> DataFrame:
    """The 50 most frequent message forms among anomalies."""
    e = once(entries(df, o.exclude).where(F.col("anomaly_type").isNotNull()),
             form=syslog_fingerprint(F.col("message")))
    counts = fq.frequencies(e, F.col("form"), o.by, "form", "count", limit=50)
    return counts.select(*o.by, shorten(F.col("form"), 120).alias("fingerprint"), "count")


def _error_form() -> Column:
    return F.when(F.col("severity").isin("ERROR", "FATAL", "WARN"), syslog_fingerprint(F.col("message")))


def _auth_message() -> Column:
    return F.when(F.col("is_auth_failure"), F.left("message", F.lit(100)))


def hour_by_severity(df: DataFrame, o: Options) -> DataFrame:
    """Entries per hour and severity, long form."""
    return fq.pair_counts(entries(df, o.exclude), hour_key(F.col("timestamp")), F.col("severity"),
                          "hour", "severity", o.by)


def _hour() -> Column:
    return hour_key(F.col("timestamp"))


def source_ip_table(df: DataFrame, o: Options) -> DataFrame:
    return fq.frequencies(entries(df, o.exclude), F.col("source_ip"), o.by, "ip", "count")


SYSLOG: dict[str, Output] = {
    "summary": summary,
    "severity_distribution": frequency_chart(lambda: F.col("severity")),
    "category_distribution": frequency_chart(lambda: F.col("category")),
    "anomaly_summary": share_table(lambda: F.col("anomaly_type"), "type"),
    "charts.process_distribution": frequency_chart(lambda: F.col("process")),
    "charts.hourly_timeline": hourly(_hour),
    "charts.top_source_ips": frequency_chart(lambda: F.col("source_ip")),
    "charts.top_targeted_users": frequency_chart(lambda: F.col("user")),
    "charts.auth_fail_messages": message_chart(_auth_message),
    "charts.top_errors": message_chart(_error_form, limit=20),
    "charts.anomaly_timeline": hourly(_hour, lambda: F.col("anomaly_type").isNotNull()),
    "charts.anomaly_types": frequency_chart(lambda: F.col("anomaly_type")),
    "tables.processes": share_table(lambda: F.col("process"), "process"),
    "tables.auth_failures_detail": auth_failures_detail,
    "tables.top_source_ips": source_ip_table,
    "tables.error_samples": error_samples(ERRORS, limit=500),
    "tables.anomaly_samples": anomaly_samples,
    "tables.anomaly_fingerprints": anomaly_fingerprints,
    "hour_by_severity": hour_by_severity,
    "trace_sizes": lambda df, o: trace_sizes(df),
}
