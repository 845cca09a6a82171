"""Report on PostgreSQL logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.clock import database_hour_key
from timberline.functions.numeric import exact_total, percent, round_exact
from timberline.functions.rules import lock_class
from timberline.functions.text import warning_fingerprint
from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.entries import entries
from timberline.operators.parse_database import ERROR_LEVELS, checkpoint_numbers, lag_unit
from timberline.plans.app import error_samples
from timberline.plans.common import frequency_chart, hourly, message_chart, share_table
from timberline.plans.options import Options, Output


def _hour() -> Column:
    return database_hour_key(F.col("timestamp"))


def _is(event: str) -> Column:
    return F.col("event") == event


def _count(event: str) -> Column:
    return F.count_if(_is(event))


def summary(df: DataFrame, o: Options) -> DataFrame:
    kind = F.col("stmt_type")
    return entries(df, o.exclude).groupBy(*o.by).agg(
        F.count("*").alias("total_entries"),
        _count("statement").alias("statements"), _count("error").alias("errors"),
        _count("warning").alias("warnings"), _count("checkpoint").alias("checkpoints"),
        F.count_if("slow").alias("slow_queries"),
        F.count_if(kind == "SELECT").alias("read_queries"),
        F.count_if(kind.isin("INSERT", "UPDATE", "DELETE", "COPY")).alias("write_queries"),
        F.count_if(kind.isin("BEGIN", "COMMIT", "ROLLBACK")).alias("tx_ops"),
        F.count_distinct(F.when(_is("statement"), F.col("table"))).alias("unique_tables"),
        F.count_distinct(F.nullif(F.col("pid"), F.lit(0))).alias("unique_pids"),
        _count("lock").alias("lock_events"), _count("autovacuum").alias("autovacuum_events"),
        _count("replication").alias("replication_events"),
    )


def top_errors(df: DataFrame, o: Options) -> DataFrame:
    """One row per error, not grouped."""
    return entries(df, o.exclude).where(F.col("level").isin(*ERROR_LEVELS)).select(
        *o.by, F.left("message", F.lit(120)).alias("label"), F.lit(1).cast("bigint").alias("value"))


def tables_by_duration(df: DataFrame, o: Options) -> DataFrame:
    rows = entries(df, o.exclude).where(
        _is("statement") & F.col("table").isNotNull() & F.col("duration_ms").isNotNull())
    return rows.groupBy(*o.by, "table").agg(
        exact_total(F.col("duration_ms")).alias("total"), F.min("line_no").alias("first_line")
    ).orderBy(*o.by, F.col("total").desc(), "first_line").select(
        *o.by, F.left("table", F.lit(60)).alias("label"), round_exact(F.col("total"), 2).alias("value"))


def checkpoint_metrics(df: DataFrame, o: Options) -> DataFrame:
    """No row when no checkpoint reports a total."""
    c = checkpoint_numbers(entries(df, o.exclude))

    def mean(name: str) -> Column:
        return exact_total(F.col(name)) / F.nullif(F.count(name), F.lit(0))

    sums = c.groupBy(*o.by).agg(
        F.count("*").alias("count"), F.count("total_s").alias("timed"),
        mean("total_s").alias("t"), F.max("total_s").alias("t_max"), mean("write_s").alias("w"),
        mean("sync_s").alias("s"), (F.sum(F.col("buffers").cast("decimal(38,0)")).cast("double") / F.nullif(F.count("buffers"), F.lit(0))).alias("b"))
    zero = F.lit(0.0)
    return sums.where(F.col("timed") > 0).select(
        *o.by, "count", round_exact(F.col("t"), 3).alias("total_avg"), round_exact(F.col("t_max"), 3).alias("total_max"),
        F.coalesce(round_exact(F.col("w"), 3), zero).alias("write_avg"),
        F.coalesce(round_exact(F.col("s"), 3), zero).alias("sync_avg"),
        F.coalesce(round_exact(F.col("b"), 0), zero).cast("bigint").alias("buffers_avg"))


def duration_stats(df: DataFrame, o: Options) -> DataFrame:
    """No row without durations."""
    d = stats.describe(entries(df, o.exclude), o.by, F.col("duration_ms"), digits=2)
    return d.where(F.col("count") > 0).select(*o.by, "count", "avg", "min", "p50", "p95", "p99", "max")


def slow_queries(df: DataFrame, o: Options) -> DataFrame:
    """All slow statements, longest first."""
    return entries(df, o.exclude).where(F.col("duration_ms") >= o.slow * 1000.0).orderBy(
        *o.by, F.col("duration_ms").desc(), "line_no"
    ).select(*o.by, "timestamp", "pid", "duration_ms", "table", "stmt_type",
             F.left("message", F.lit(300)).alias("message"))


def normalized_queries(df: DataFrame, o: Options) -> DataFrame:
    """Per statement form: count, mean over all its occurrences (timed or not), first table and type."""
    rows = entries(df, o.exclude).where(_is("statement") & (F.col("normalized") != ""))
    first = F.min(F.struct("line_no", "table", "stmt_type"))
    grouped = rows.withColumn("form", F.left("normalized", F.lit(200))).groupBy(*o.by, "form").agg(
        F.count("*").alias("count"), F.coalesce(exact_total(F.col("duration_ms")), F.lit(0.0)).alias("total"),
        first.alias("f"))
    return grouped.orderBy(*o.by, F.col("count").desc(), F.col("f.line_no")).select(
        *o.by, F.col("form").alias("normalized"), "count",
        round_exact(F.col("total") / F.col("count"), 2).alias("avg_duration_ms"),
        F.col("f.table").alias("sample_table"), F.col("f.stmt_type").alias("sample_stmt_type"))


def _event_rows(event: str, *columns: str) -> Output:
    def output(df: DataFrame, o: Options) -> DataFrame:
        rows = entries(df, o.exclude).where(_is(event)).orderBy("source", "line_no")
        return rows.select(*o.by, "timestamp", "pid", *[
            F.col("vacuum_table").alias("table") if c == "table" else
            F.left("message", F.lit(200)).alias("message") if c == "message" else F.col(c) for c in columns])
    return output


def lag_stats(df: DataFrame, o: Options, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lag figures over all units together; no row when no lag is reported."""
    value = F.col("lag_value").try_cast("double")
    rows = entries(df, o.exclude).where(_is("replication")).select(*o.by, *extra, value.alias("v"))
    s = rows.groupBy(*o.by, *extra).agg(
        F.count("v").alias("count"), (exact_total(F.col("v")) / F.nullif(F.count("v"), F.lit(0))).alias("a"),
        F.max("v").alias("hi"), F.min("v").alias("lo"))
    return s.where(F.col("count") > 0).select(
        *o.by, *extra, "count", round_exact(F.col("a"), 2).alias("avg"), round_exact(F.col("hi"), 2).alias("max"),
        round_exact(F.col("lo"), 2).alias("min"))


def event_totals(df: DataFrame, o: Options) -> DataFrame:
    """Totals of lock, vacuum and replication events."""
    return entries(df, o.exclude).groupBy(*o.by).agg(
        _count("lock").alias("lock_total"), _count("autovacuum").alias("autovacuum_total"),
        _count("replication").alias("replication_total"))


def warning_samples(df: DataFrame, o: Options) -> DataFrame:
    rows = entries(df, o.exclude).where(F.col("level") == "WARNING").orderBy("source", "line_no")
    return rows.select(*o.by, "timestamp", F.lit("WARNING").alias("level"), F.left("message", F.lit(200)).alias("message"))


def _warning_form() -> Column:
    return F.when(F.col("level") == "WARNING", warning_fingerprint(F.col("message")))


def top_tables(df: DataFrame, o: Options) -> DataFrame:
    counts = fq.frequencies(entries(df, o.exclude), F.col("table"), o.by, "table")
    return counts.select(*o.by, F.left("table", F.lit(60)).alias("label"), "value")


DATABASE: dict[str, Output] = {
    "summary": summary,
    "charts.level_distribution": frequency_chart(lambda: F.col("level")),
    "charts.stmt_type_distribution": frequency_chart(lambda: F.col("stmt_type")),
    "charts.top_tables": top_tables,
    "charts.hourly_timeline": hourly(_hour),
    "charts.hourly_stmts": hourly(_hour, lambda: F.col("stmt_type").isNotNull()),
    "charts.hourly_errors": hourly(_hour, lambda: F.col("level").isin(*ERROR_LEVELS)),
    "charts.top_warnings": message_chart(_warning_form),
    "charts.top_errors": top_errors,
    "charts.duration_histogram": lambda d, o: stats.duration_classes(
        entries(d, o.exclude), F.col("duration_ms"), o.by),
    "charts.top_tables_by_duration": tables_by_duration,
    "charts.hourly_ckpt": lambda d, o: fq.timeline(
        checkpoint_numbers(entries(d, o.exclude)), _hour(), o.by, F.col("total_s").isNotNull()),
    "charts.lock_by_type": frequency_chart(lambda: F.when(_is("lock"), lock_class(F.left("message", F.lit(300))))),
    "charts.lock_by_hour": hourly(_hour, lambda: _is("lock")),
    "charts.autovacuum_by_table": frequency_chart(lambda: F.left("vacuum_table", F.lit(60))),
    "charts.autovacuum_by_hour": hourly(_hour, lambda: _is("autovacuum")),
    "charts.replication_by_hour": hourly(_hour, lambda: _is("replication")),
    "checkpoint_metrics": checkpoint_metrics,
    "duration_stats": duration_stats,
    "slow_queries": slow_queries,
    "normalized_queries": normalized_queries,
    "lock_events": _event_rows("lock", "level", "message"),
    "autovacuum_events": _event_rows("autovacuum", "table", "dead_tuples", "live_tuples", "message"),
    "replication_events": _event_rows("replication", "level", "message", "lag_value", "lag_unit"),
    "event_totals": event_totals,
    "lag_stats": lag_stats,
    "lag_stats_by_unit": lambda d, o: lag_stats(d.withColumn("lag_unit", lag_unit(F.col("message"))), o, ("lag_unit",)),
    "tables.levels": share_table(lambda: F.col("level"), "level"),
    "tables.statement_types": share_table(lambda: F.col("stmt_type"), "stmt_type", of_labelled=True),
    "tables.top_tables": share_table(lambda: F.col("table"), "table", of_labelled=True),
    "tables.error_samples": error_samples(ERROR_LEVELS),
    "tables.warning_samples": warning_samples,
}
