"""Reports on container and API logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.clock import hour_key
from timberline.functions.numeric import number_label, percent
from timberline.functions.rules import API_LEVEL_RANK, rank_of
from timberline.functions.text import container_fingerprint
from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.entries import entries
from timberline.operators.positions import indexed_rows
from timberline.plans.common import frequency_chart, hourly, message_chart, share_table
from timberline.plans.options import Options, Output

CONTAINER_ERRORS = ("ERROR", "FATAL")
API_ERRORS = ("error", "fatal", "critical")


def container_summary(df: DataFrame, o: Options) -> DataFrame:
    level, stream = F.col("level"), F.col("stream")
    return entries(df, o.exclude).groupBy(*o.by).agg(
        F.count("*").alias("total_entries"),
        F.count_if(stream == "stdout").alias("stdout_count"), F.count_if(stream == "stderr").alias("stderr_count"),
        F.count_if(level.isin(*CONTAINER_ERRORS)).alias("error_count"), F.count_if(level == "WARN").alias("warn_count"),
    ).withColumn("error_rate", percent(F.col("error_count"), F.col("total_entries")))


def error_samples(levels: tuple[str, ...], upper: bool = False, limit: int | None = None,
                  length: int | None = 200) -> Output:
    """Error entries as ``(timestamp, level, message, entry_idx)`` in source order."""
    def output(df: DataFrame, o: Options) -> DataFrame:
        name = "level" if "level" in df.columns else "severity"
        level = F.upper(name) if upper else F.col(name)
        message = F.col("message") if length is None else F.left("message", F.lit(length))
        rows = indexed_rows(entries(df, o.exclude), level.isin(*levels), {
            "timestamp": F.col("timestamp"), "level": F.col(name), "message": message})
        if limit is not None and o.by:
            place = F.row_number().over(W.partitionBy(*o.by).orderBy("source", "entry_idx"))
            rows = rows.withColumn("_place", place).where(F.col("_place") <= limit)
        rows = rows.orderBy("source", "entry_idx")
        if limit is not None and not o.by:
            rows = rows.limit(limit)
        return rows.select(*o.by, "timestamp", "level", "message", "entry_idx")
    return output


def _container_print() -> Column:
    return F.when(F.col("level").isin(*CONTAINER_ERRORS), container_fingerprint(F.col("message")))


CONTAINER: dict[str, Output] = {
    "summary": container_summary,
    "charts.level_distribution": frequency_chart(lambda: F.col("level")),
    "charts.stream_distribution": frequency_chart(lambda: F.col("stream")),
    "charts.hourly_timeline": hourly(lambda: hour_key(F.col("timestamp"))),
    "charts.top_errors": message_chart(_container_print),
    "tables.levels": share_table(lambda: F.col("level"), "level"),
    "tables.error_samples": error_samples(CONTAINER_ERRORS),
}


def api_summary(df: DataFrame, o: Options) -> DataFrame:
    e = entries(df, o.exclude)
    level = F.col("level")
    path = F.nullif(F.col("path"), F.lit(""))
    counts = e.groupBy(*o.by).agg(F.count_distinct(path).alias("unique_endpoints"))
    timing = stats.describe(e, o.by, F.col("duration"), quantiles={"p95": 0.95, "p99": 0.99}, measures={
        "errors": ("sum", F.when(level.isin(*API_ERRORS), 1).otherwise(0)),
        "warns": ("sum", F.when(level.isin("warn", "warning"), 1).otherwise(0))})
    joined = timing.join(counts, list(o.by)) if o.by else timing.crossJoin(F.broadcast(counts))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *o.by, F.col("rows").alias("total_entries"), F.coalesce("errors", zero).alias("error_count"),
        F.coalesce("warns", zero).alias("warn_count"), "unique_endpoints",
        percent(F.coalesce("errors", zero), F.col("rows")).alias("error_rate"),
        F.col("avg").alias("avg_duration"), F.col("p95").alias("p95_duration"), F.col("p99").alias("p99_duration"),
        F.col("max").alias("max_duration"))


def _endpoint() -> Column:
    """``METHOD path``, or the path alone; NULL without a path."""
    path, method = F.nullif(F.col("path"), F.lit("")), F.nullif(F.col("method"), F.lit(""))
    return F.when(path.isNotNull(), F.concat_ws(" ", method, path))


def endpoint_details(df: DataFrame, o: Options) -> DataFrame:
    """Per endpoint: volume, errors, durations; busiest first. Status codes are a table of their own."""
    e = entries(df, o.exclude).withColumn("endpoint", _endpoint())
    return stats.describe(e, [*o.by, "endpoint"], F.col("duration"), quantiles={"p95": 0.95}, measures={
        "errors": ("sum", F.when(F.col("level").isin(*API_ERRORS), 1).otherwise(0)),
        "first_line": ("min", F.col("line_no"))}
    ).orderBy(*o.by, F.col("rows").desc(), "first_line").select(
        *o.by, "endpoint", F.col("rows").alias("count"), "errors",
        percent(F.col("errors"), F.col("rows")).alias("error_rate"),
        F.col("avg").alias("avg_duration"), F.col("p95").alias("p95_duration"), F.col("max").alias("max_duration"))


def endpoint_statuses(df: DataFrame, o: Options) -> DataFrame:
    """Status codes per endpoint in long form."""
    return fq.pair_counts(entries(df, o.exclude), _endpoint(), F.col("status"), "endpoint", "status", o.by)


def duration_histogram(df: DataFrame, o: Options) -> DataFrame:
    h = stats.equal_count_histogram(entries(df, o.exclude), F.col("duration"), o.by, cap_steps=False)
    return h.select(*o.by, "bucket", F.concat(F.lit("≤"), number_label(F.col("upper")), F.lit("s")).alias("label"),
                    "value")


def api_levels(df: DataFrame, o: Options) -> DataFrame:
    return fq.shares(entries(df, o.exclude), F.col("level"), o.by, "level",
                     extra={"severity": rank_of(F.col("level"), API_LEVEL_RANK, 2)})


def _api_error_head() -> Column:
    return F.when(F.col("level").isin(*API_ERRORS), F.nullif(F.left("message", F.lit(100)), F.lit("")))


API: dict[str, Output] = {
    "summary": api_summary,
    "charts.level_distribution": frequency_chart(lambda: F.col("level")),
    "charts.hourly_timeline": hourly(lambda: hour_key(F.col("timestamp"))),
    "charts.top_endpoints": frequency_chart(lambda: F.nullif(F.col("path"), F.lit(""))),
    "charts.method_distribution": frequency_chart(lambda: F.nullif(F.col("method"), F.lit(""))),
    "charts.status_distribution": frequency_chart(lambda: F.col("status").cast("string")),
    "charts.duration_histogram": duration_histogram,
    "charts.top_errors": message_chart(_api_error_head),
    "tables.levels": api_levels,
    "tables.endpoint_details": endpoint_details,
    "tables.endpoint_statuses": endpoint_statuses,
    "tables.error_samples": error_samples(API_ERRORS),
}
