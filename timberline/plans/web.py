"""Reports on web-server access and error logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.clock import hour_key
from timberline.functions.numeric import human_bytes, number_label, percent, round_exact
from timberline.functions.rules import WEB_LEVEL_RANK, rank_of
from timberline.functions.text import digits_to_n, shorten
from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.entries import entries
from timberline.operators.positions import entry_index
from timberline.plans.common import frequency_chart, join_reports
from timberline.plans.options import Options, Output



def _one(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _hourly(df: DataFrame, o: Options) -> DataFrame:
    """Per hour: requests, response-time statistics, count over the critical threshold."""
    e = entries(df, o.exclude).withColumn("hour", hour_key(F.col("timestamp")))
    over = _one(F.col("response_time") > o.critical)
    return stats.describe(e, [*o.by, "hour"], F.col("response_time"),
                          measures={"slow_count": ("sum", over)}, quantiles={"p95": 0.95})


def hourly_performance(df: DataFrame, o: Options) -> DataFrame:
    return performance_rows(_hourly(df, o), o)


def performance_rows(hours: DataFrame, o: Options) -> DataFrame:
    """Output rows from the statistics of each hour."""
    state = (
        F.when(F.coalesce("max", F.lit(0.0)) > o.critical, "critical")
        .when(F.coalesce("avg", F.lit(0.0)) > o.slow, "degraded").otherwise("healthy")
    )
    return hours.select(
        *o.by, "hour", F.col("rows").alias("requests"), F.col("avg").alias("avg_rt"),
        F.col("p95").alias("p95_rt"), F.col("max").alias("max_rt"), state.alias("status"),
    ).orderBy(*o.by, "hour")


def incidents(df: DataFrame, o: Options) -> DataFrame:
    """Hours with a slow average or a critical maximum; ``slow_count`` counts values over critical."""
    return incident_rows(_hourly(df, o), o)


def incident_rows(hours: DataFrame, o: Options) -> DataFrame:
    mean, top = F.col("exact_avg"), F.col("exact_max")
    severity = F.when((top > o.critical) | (mean > o.critical), "critical").otherwise("degraded")
    return hours.where((F.col("count") > 0) & ((mean > o.slow) | (top > o.critical))).select(
        *o.by, F.col("hour").alias("period"), severity.alias("severity"), F.col("avg").alias("avg_rt"),
        F.col("p95").alias("p95_rt"), F.col("max").alias("max_rt"), F.col("count").alias("request_count"),
        "slow_count",
    ).orderBy(*o.by, "period")


def summary(df: DataFrame, o: Options) -> DataFrame:
    """One fold by hour and value gives the statistics and the incidents; the distinct counts are the other pass."""
    e = entries(df, o.exclude).withColumn("hour", hour_key(F.col("timestamp")))
    kinds = {"total_bytes": "total", "errors": "sum", "slow_count": "sum"}
    folded = stats.value_counts(e, [*o.by, "hour"], F.col("response_time"), {
        "total_bytes": ("total", F.col("bytes")), "errors": ("sum", _one(F.col("status") >= 400)),
        "slow_count": ("sum", _one(F.col("response_time") > o.critical))})
    timing = stats.describe_counts(stats.merge_counts(folded, o.by, kinds), o.by, kinds=kinds)
    distinct = e.groupBy(*o.by).agg(
        F.count_distinct("ip").alias("unique_ips"), F.count_distinct("path").alias("unique_paths"))
    bad = incident_rows(stats.describe_counts(folded, [*o.by, "hour"], kinds=kinds, quantiles={"p95": 0.95}), o)
    found = bad.groupBy(*o.by).agg(F.count("*").alias("incident_count"))
    top = F.coalesce("exact_max", F.lit(0.0))
    health = (
        F.when(top > o.critical, "critical")
        .when((F.coalesce("p95", F.lit(0.0)) > o.slow) | (top > o.slow), "degraded").otherwise("healthy")
    )
    total = F.coalesce("total_bytes", F.lit(0).cast("bigint"))
    return join_reports([timing, distinct, found], o.by).select(
        *o.by, F.col("rows").alias("total_requests"), "unique_ips", "unique_paths",
        total.alias("total_bytes"), human_bytes(total).alias("total_bytes_human"),
        percent(F.coalesce("errors", F.lit(0)), F.col("rows")).alias("error_rate"), health.alias("health"),
        F.coalesce("incident_count", F.lit(0).cast("bigint")).alias("incident_count"),
        "count", "avg", "min", "p50", "p95", "p99", "max",
    )


def upstream_timing(df: DataFrame, o: Options) -> DataFrame:
    return stats.describe_columns(entries(df, o.exclude), {
        "rt": F.col("response_time"), "urt": F.col("upstream_response_time"),
        "uht": F.col("upstream_header_time"), "uct": F.col("upstream_connect_time"),
    }, o.by).select(*o.by, "metric", "count", "avg", "min", "p50", "p95", "p99", "max")


def _endpoints(df: DataFrame, o: Options) -> DataFrame:
    e = entries(df, o.exclude)
    return stats.describe(e, [*o.by, "path"], F.col("response_time"), measures={
        "errors": ("sum", _one(F.col("status") >= 400)), "first_line": ("min", F.col("line_no"))})


def endpoint_performance(df: DataFrame, o: Options) -> DataFrame:
    """Per path, slowest average first."""
    return _endpoints(df, o).orderBy(
        *o.by, F.coalesce("avg", F.lit(0.0)).desc(), F.col("first_line")
    ).select(
        *o.by, "path", F.col("rows").alias("count"), percent(F.col("errors"), F.col("rows")).alias("error_rate"),
        F.col("count").alias("rt_count"), F.col("avg").alias("rt_avg"), F.col("min").alias("rt_min"),
        F.col("p50").alias("rt_p50"), F.col("p95").alias("rt_p95"), F.col("p99").alias("rt_p99"),
        F.col("max").alias("rt_max"),
    )


def endpoint_rt(df: DataFrame, o: Options) -> DataFrame:
    return endpoint_performance(df, o).select(
        *o.by, F.col("path").alias("label"), F.col("rt_avg").alias("avg"), F.col("rt_p95").alias("p95"),
        F.col("rt_max").alias("max"), "count")


def ip_details(df: DataFrame, o: Options) -> DataFrame:
    """Per client: volume, first and last seen, timings, status codes; busiest first."""
    e = entries(df, o.exclude)
    base = stats.describe(e, [*o.by, "ip"], F.col("response_time"), quantiles={"p95": 0.95}, measures={
        "first_seen": ("min", F.col("timestamp")), "last_seen": ("max", F.col("timestamp")),
        "total_bytes": ("total", F.col("bytes")), "first_line": ("min", F.col("line_no"))})
    codes = fq.status_lists(e, F.col("ip"), F.col("status"), "ip", o.by)
    return base.join(codes, [*o.by, "ip"], "left").orderBy(*o.by, F.col("rows").desc(), "first_line").select(
        *o.by, "ip", F.col("rows").alias("total"), "first_seen", "last_seen", "total_bytes",
        F.col("avg").alias("avg_rt"), F.col("min").alias("min_rt"), F.col("max").alias("max_rt"),
        F.col("p95").alias("p95_rt"), "status_codes")


def response_time_histogram(df: DataFrame, o: Options) -> DataFrame:
    h = stats.equal_count_histogram(entries(df, o.exclude), F.col("response_time"), o.by)
    return h.select(*o.by, "bucket", F.concat(F.lit("≤"), number_label(F.col("upper"))).alias("label"), "value")


def bytes_distribution(df: DataFrame, o: Options) -> DataFrame:
    h = stats.equal_count_histogram(entries(df, o.exclude), F.col("bytes"), o.by)
    return h.select(*o.by, "bucket",
                    F.concat(F.lit("≤"), F.col("upper").cast("bigint").cast("string")).alias("label"), "value")


def rt_scatter(df: DataFrame, o: Options) -> DataFrame:
    """Every (n // 500)-th entry of each source that has a response time."""
    e = entries(df, o.exclude).select("source", "line_no", "timestamp", "response_time", "path", "status")
    step = F.greatest(F.lit(1), F.floor(F.col("entry_total") / 500))
    return entry_index(e, with_total=True).where(
        (F.col("entry_idx") % step == 0) & F.col("response_time").isNotNull()
    ).orderBy("source", "entry_idx").select(
        *o.by, F.col("timestamp").alias("t"), round_exact(F.col("response_time"), 3).alias("rt"), "path", "status")


def dimensions(df: DataFrame, o: Options) -> DataFrame:
    """Status, method, path, client and hour counts in a single pass."""
    return fq.dimension_counts(entries(df, o.exclude), {
        "status": F.col("status"), "method": F.col("method"), "path": F.col("path"), "ip": F.col("ip"),
        "hour": hour_key(F.col("timestamp"))}, o.by)


ACCESS: dict[str, Output] = {
    "summary": summary,
    "upstream_timing": upstream_timing,
    "charts.status_distribution": frequency_chart(lambda: F.col("status").cast("string")),
    "charts.hourly_timeline": lambda d, o: fq.timeline(
        entries(d, o.exclude), hour_key(F.col("timestamp")), o.by),
    "charts.method_distribution": frequency_chart(lambda: F.col("method")),
    "charts.top_endpoints": frequency_chart(lambda: F.col("path")),
    "charts.top_ips": frequency_chart(lambda: F.col("ip")),
    "charts.response_time_histogram": response_time_histogram,
    "charts.bytes_distribution": bytes_distribution,
    "charts.rt_scatter": rt_scatter,
    "charts.endpoint_rt": endpoint_rt,
    "tables.ip_details": ip_details,
    "tables.status_codes": lambda d, o: fq.shares(
        entries(d, o.exclude), F.col("status").cast("string"), o.by, "code"),
    "tables.top_endpoints": lambda d, o: fq.shares(entries(d, o.exclude), F.col("path"), o.by, "path"),
    "tables.endpoint_performance": endpoint_performance,
    "tables.hourly_performance": hourly_performance,
    "tables.incidents": incidents,
    "dimensions": dimensions,
}


def error_summary(df: DataFrame, o: Options) -> DataFrame:
    level = F.col("level")
    return entries(df, o.exclude).groupBy(*o.by).agg(
        F.count("*").alias("total_errors"), F.count_distinct("client").alias("unique_clients"),
        F.count_if(level.isin("crit", "emerg", "alert")).alias("crit_count"),
        F.count_if(level == "error").alias("error_count"), F.count_if(level == "warn").alias("warn_count"))


def error_levels(df: DataFrame, o: Options) -> DataFrame:
    """Level shares with their rank, most severe first."""
    table = fq.shares(entries(df, o.exclude), F.col("level"), o.by, "level",
                      extra={"severity": rank_of(F.col("level"), WEB_LEVEL_RANK, 5)})
    return table.orderBy(*o.by, "severity", F.col("count").desc())


def _messages(name: str, text: Callable[[], Column]) -> Output:
    def output(df: DataFrame, o: Options) -> DataFrame:
        counts = fq.frequencies(entries(df, o.exclude), digits_to_n(F.col("message")), o.by, "_m", "_c")
        count = "value" if name == "label" else "count"
        return counts.select(*o.by, text().alias(name), F.col("_c").alias(count))
    return output


ERROR: dict[str, Output] = {
    "summary": error_summary,
    "charts.level_distribution": frequency_chart(lambda: F.col("level")),
    "charts.hourly_timeline": lambda d, o: fq.timeline(
        entries(d, o.exclude), hour_key(F.col("timestamp")), o.by),
    "charts.top_clients": frequency_chart(lambda: F.nullif(F.col("client"), F.lit(""))),
    "charts.top_messages": _messages("label", lambda: shorten(F.col("_m"))),
    "tables.levels": error_levels,
    "tables.top_clients": lambda d, o: fq.shares(
        entries(d, o.exclude), F.nullif(F.col("client"), F.lit("")), o.by, "client"),
    "tables.top_messages": _messages("message", lambda: F.left(F.col("_m"), F.lit(120))),
}
