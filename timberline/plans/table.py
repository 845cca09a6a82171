"""Report on CSV logs; a block is empty when no header stands for its column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.clock import day_key, hour_key
from timberline.functions.numeric import exact_total, human_bytes, percent, round_exact, to_float
from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.entries import entries
from timberline.operators.once import all_of
from timberline.operators.parse_csv import TARGETS
from timberline.plans.app import error_samples
from timberline.plans.common import frequency_chart, hourly, join_reports, message_chart
from timberline.plans.options import Options, Output

ERRORS = ("ERROR", "FATAL", "CRITICAL")


def _mapped(name: str) -> Column:
    return F.array_contains("mapped", name)


def _level_label() -> Column:
    """A blank cell of a level column has no label; without a level column it is UNKNOWN."""
    return F.when(_mapped("level"), F.col("level")).otherwise(F.coalesce("level", F.lit("UNKNOWN")))


def _entries(df: DataFrame, o: Options) -> DataFrame:
    return entries(df, o.exclude).drop("is_header")


def levels(df: DataFrame, o: Options) -> DataFrame:
    seen = _mapped("level") | F.col("level").isNotNull()
    return fq.shares(_entries(df, o), _level_label(), o.by, "level", detected=seen)


def level_distribution(df: DataFrame, o: Options) -> DataFrame:
    return levels(df, o).select(*o.by, F.col("level").alias("label"), F.col("count").alias("value"))


def status_codes(df: DataFrame, o: Options) -> DataFrame:
    return fq.shares(_entries(df, o), F.col("status"), o.by, "status", detected=_mapped("status"))


def status_distribution(df: DataFrame, o: Options) -> DataFrame:
    return status_codes(df, o).select(*o.by, F.col("status").alias("label"), F.col("count").alias("value"))


def message_summary(df: DataFrame, o: Options) -> DataFrame:
    table = fq.shares(_entries(df, o), F.col("message"), o.by, "message")
    return table.withColumn("message", F.left("message", F.lit(120)))


def daily_performance(df: DataFrame, o: Options) -> DataFrame:
    e = _entries(df, o).where(F.col("timestamp").isNotNull())
    level = F.col("level")
    return e.select(*o.by, day_key(F.col("timestamp")).alias("date"), "level").groupBy(*o.by, "date").agg(
        F.count("*").alias("requests"), F.count_if(level.isin(*ERRORS)).alias("errors"),
        F.count_if(level == "WARN").alias("warnings"), F.count_if(level == "INFO").alias("info"),
    ).withColumn("error_rate", percent(F.col("errors"), F.col("requests"))).orderBy(*o.by, "date")


def summary(df: DataFrame, o: Options) -> DataFrame:
    e = _entries(df, o)
    level = F.col("level")
    seen = [F.bool_or(_mapped(t) | (F.col(t).isNotNull() if t in ("level", "message") else F.lit(False))).alias(f"_{t}")
            for t in TARGETS]
    size = to_float(F.col("bytes"))
    # sums, counts and flags only: a text or list among them makes Spark sort the rows instead of hashing them
    counts = e.groupBy(*o.by).agg(
        *seen,
        F.count_if(level.isin(*ERRORS)).alias("_errors"), F.count_if(level == "INFO").alias("_info"),
        F.count_if(level == "WARN").alias("_warn"),
        F.count_distinct("ip").alias("_ips"), F.count_distinct("endpoint").alias("_endpoints"),
        exact_total(size).alias("_bytes_total"))
    folded = stats.value_counts(e, [*o.by, "header_names"], to_float(F.col("duration")))
    timing = stats.describe_counts(stats.merge_counts(folded, o.by), o.by, digits=2, quantiles={"p95": 0.95, "p99": 0.99})
    headers = folded.where(all_of(*folded.columns)).select(*o.by, "header_names").distinct()
    names = headers.groupBy(*o.by).agg(F.min("header_names").alias("all_columns"))
    has_level = F.col("_level")
    columns = F.array_sort(F.filter(
        F.array(*[F.when(F.col(f"_{t}"), F.lit(t)) for t in TARGETS]), lambda t: t.isNotNull()))
    total = F.col("_bytes_total")
    return join_reports([timing, counts, names], o.by).select(
        *o.by, F.col("rows").alias("total_entries"), columns.alias("columns"), "all_columns",
        F.when(has_level, F.col("_errors")).alias("error_count"),
        F.when(has_level, percent(F.col("_errors"), F.col("rows"))).alias("error_rate"),
        F.when(has_level, F.col("_info")).alias("matches_found"),
        F.when(has_level, F.col("_warn")).alias("no_match_count"),
        F.col("avg").alias("avg_duration"), F.col("p95").alias("p95_duration"), F.col("p99").alias("p99_duration"),
        F.col("max").alias("max_duration"), F.col("min").alias("min_duration"),
        F.when(F.col("_ip"), F.col("_ips")).alias("unique_ips"),
        F.when(F.col("_endpoint"), F.col("_endpoints")).alias("unique_endpoints"),
        round_exact(total, 0).try_cast("bigint").alias("total_bytes"),
        human_bytes(total, 1).alias("total_bytes_human"))


def duration_histogram(df: DataFrame, o: Options) -> DataFrame:
    h = stats.equal_width_histogram(_entries(df, o), to_float(F.col("duration")), o.by)
    label = F.concat(F.format_string("%.1f", "lower"), F.lit("-"), F.format_string("%.1f", "upper"))
    return h.select(*o.by, "bucket", label.alias("label"), "value")


def ip_details(df: DataFrame, o: Options) -> DataFrame:
    """Per client, busiest first. Its endpoints, methods and levels are tables of their own."""
    e = _entries(df, o).where(F.col("ip").isNotNull())
    return e.groupBy(*o.by, "ip").agg(
        F.count("*").alias("total"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_if(F.col("level").isin(*ERRORS)).alias("error_count"),
        F.count_distinct("user").alias("unique_users"), F.min("line_no").alias("_first"),
    ).withColumn("error_rate", percent(F.col("error_count"), F.col("total"))).orderBy(
        *o.by, F.col("total").desc(), "_first").drop("_first")


def endpoint_details(df: DataFrame, o: Options) -> DataFrame:
    """Per endpoint, busiest first. Its clients and methods are tables of their own."""
    e = _entries(df, o).where(F.col("endpoint").isNotNull())
    return e.groupBy(*o.by, "endpoint").agg(
        F.count("*").alias("total"), F.count_distinct("ip").alias("unique_ips"),
        F.count_if(F.col("level").isin(*ERRORS)).alias("error_count"),
        F.count_distinct("user").alias("unique_users"), F.min("line_no").alias("_first"),
    ).withColumn("error_rate", percent(F.col("error_count"), F.col("total"))).orderBy(
        *o.by, F.col("total").desc(), "_first").drop("_first")


def _pairs(key: str, sub: str) -> Output:
    def output(df: DataFrame, o: Options) -> DataFrame:
        return fq.pair_counts(_entries(df, o), F.col(key), F.col(sub), key, sub, o.by)
    return output


def top_endpoints(df: DataFrame, o: Options) -> DataFrame:
    counts = fq.frequencies(_entries(df, o), F.col("endpoint"), o.by, "endpoint")
    return counts.select(*o.by, F.left("endpoint", F.lit(80)).alias("label"), "value")


def all_rows(df: DataFrame, o: Options) -> DataFrame:
    return _entries(df, o).select("source", "line_no", *TARGETS, "extra")


def _timed() -> Column:
    return F.col("timestamp").isNotNull()


TABLE: dict[str, Output] = {
    "summary": summary,
    "charts.hourly_timeline": hourly(lambda: hour_key(F.col("timestamp")), _timed),
    "charts.daily_timeline": hourly(lambda: day_key(F.col("timestamp")), _timed),
    "charts.level_distribution": level_distribution,
    "charts.message_distribution": message_chart(lambda: F.col("message")),
    "charts.status_distribution": status_distribution,
    "charts.method_distribution": frequency_chart(lambda: F.col("method")),
    "charts.duration_histogram": duration_histogram,
    "charts.top_ips": frequency_chart(lambda: F.col("ip")),
    "charts.top_endpoints": top_endpoints,
    "tables.daily_performance": daily_performance,
    "tables.levels": levels,
    "tables.error_samples": error_samples(ERRORS, upper=True, length=None),
    "tables.message_summary": message_summary,
    "tables.status_codes": status_codes,
    "tables.ip_details": ip_details,
    "tables.ip_endpoints": _pairs("ip", "endpoint"),
    "tables.ip_methods": _pairs("ip", "method"),
    "tables.ip_levels": _pairs("ip", "level"),
    "tables.endpoint_details": endpoint_details,
    "tables.endpoint_ips": _pairs("endpoint", "ip"),
    "tables.endpoint_methods": _pairs("endpoint", "method"),
    "tables.all_rows": all_rows,
}
