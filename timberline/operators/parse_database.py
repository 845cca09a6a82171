"""PostgreSQL stderr lines -> typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import capture, first_match, group, normalize_sql, strip
from timberline.operators.once import once

# fixed values: line forms, statement words and event patterns
DATABASE_LINE = (
    r"(?s)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\S+)\s+\[(\d+)\]"
    r"\s+(LOG|WARNING|ERROR|FATAL|PANIC|DEBUG|INFO|NOTICE|DETAIL|HINT|STATEMENT|CONTEXT)\s*:\s+(.+)\z"
)
BANNER = r"^(?:PostgreSQL\s|LOG:\s)"
DURATION = r"duration:\s*([\d.]+)\s*ms"
STATEMENT = r"statement:\s*(.+)"
STATEMENT_TYPE = (
    r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|BEGIN|COMMIT|ROLLBACK|SET|CREATE|ALTER|DROP|TRUNCATE|COPY)\b"
)
STATEMENT_TABLE = r'(?i)(?:FROM|INTO|UPDATE|JOIN)\s+"?([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)?)"?'
LOCK = (
    r"(?i)(?:deadlock detected|lock (?:timeout|wait)|waiting for (?:Lock|relation)|"
    r"lock .* on (?:relation|tuple)|process \d+ conflicts with process \d+|"
    r"could not (?:serialize|obtain) lock)"
)
AUTOVACUUM = (
    r"(?i)autovacuum(?:\s+launcher)?(?:\s+worker)?(?:\s+\d+)?:?\s+for table\s+"
    r'"?([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)?)"?\s*:?\s*(.*)'
)
DEAD_TUPLES = r"(?i)(\d+)\s+dead\s+tuples"
LIVE_TUPLES = r"(?i)(\d+)\s+live\s+tuples"
REPLICATION = (
    r"(?i)(?:replication (?:slot|origin|lag|timeout|checkpoint)|"
    r"wal (?:sender|receiver|segment|archive|level)|"
    r"standby (?:mode|connected|sync)|"
    r"remote (?:write|flush|apply|replay))"
)
LAG = r"(?i)(?:replication lag|lag)\s*[=:]\s*([\d.]+)\s*(ms|s|min|m|h|bytes|kB|MB|GB)?"
LAG_UNIT = r"(?i)(?:replication lag|lag)\s*[=:]\s*[\d.]+\s*(ms|s|min|m|h|bytes|kB|MB|GB)\b"
CHECKPOINT_TOTAL = r"total=(\d+\.\d+)\s*s"
CHECKPOINT_WRITE = r"write=(\d+\.\d+)\s*s"
CHECKPOINT_SYNC = r"sync=(\d+\.\d+)\s*s"
CHECKPOINT_BUFFERS = r"wrote\s+(\d+)\s+buffers"

ERROR_LEVELS = ("ERROR", "FATAL", "PANIC")


def _event(message: Column, level: Column, statement: Column) -> Column:
    """Kind of event, first rule wins."""
    return (
        F.when(statement.isNotNull(), "statement")
        .when(message.rlike(DURATION), "duration")
        .when(F.startswith(message, F.lit("statement:")), "statement")
        .when(message.rlike(LOCK), "lock")
        .when(message.rlike(AUTOVACUUM), "autovacuum")
        .when(message.rlike(REPLICATION), "replication")
        .when(F.startswith(message, F.lit("checkpoint")), "checkpoint")
        .when(F.contains(message, F.lit("database system is ready")), "ready")
        .when(F.contains(message, F.lit("database system was")) & F.contains(message, F.lit("recovery")), "recovery")
        .when(F.contains(message, F.lit("listening on")), "listen")
        .when(level.isin(*ERROR_LEVELS), "error")
        .when(level == "WARNING", "warning")
        .otherwise("other")
    )


def parse_database(lines: DataFrame, slow_seconds: float = 10.0) -> DataFrame:
    """Statements, durations, locks, vacuums, replication, checkpoints, errors.

    Lock, vacuum and replication details are nullable columns of the same row,
    so the event tables are filters on ``event``. ``slow_seconds`` is the slow
    statement threshold.
    """
    text, g = F.col("_text"), F.col("_g")
    banner = text.rlike(BANNER)
    message, level, sql = F.col("_message"), F.col("level"), F.col("_sql")
    timed = message.rlike(DURATION)
    statement = F.when(
        timed, strip(first_match(message, STATEMENT))
    ).when(F.startswith(message, F.lit("statement:")), strip(F.substr(message, F.lit(11))))
    millis = F.when(timed, first_match(message, DURATION).try_cast("double"))
    event, vacuum = F.col("event"), F.regexp_extract(message, AUTOVACUUM, 2)
    split = once(lines.select("source", "line_no", strip(F.col("value")).alias("_text")),
                 _banner=banner, _g=capture(text, DATABASE_LINE, 5))
    banner = F.col("_banner")
    named = split.select(
        "source", "line_no", "_text", "_banner",
        F.when(banner, F.lit("")).otherwise(F.regexp_replace(group(g, 1), r"^([^ ]*) ", "$1T")).alias("timestamp"),
        F.when(banner, F.lit(0)).otherwise(group(g, 3).try_cast("bigint")).alias("pid"),
        F.when(banner, "INFO").otherwise(group(g, 4)).alias("level"), F.when(~banner, group(g, 2)).alias("zone"),
        F.when(banner, text).otherwise(strip(group(g, 5))).alias("_message"),
    )
    timed_rows = once(named, _sql=F.when(~banner, statement), duration_ms=F.when(~banner, millis))
    return (
        once(timed_rows, event=F.when(banner, "startup").when(message.isNotNull(), _event(message, level, sql)))
        .select(
            "source", "line_no", message.isNotNull().alias("parsed"), (text == "").alias("blank"),
            "timestamp", "pid", "level", "event",
            F.when(banner, message).otherwise(F.left(message, F.lit(500))).alias("message"),
            F.when(sql.isNotNull(), first_match(sql, STATEMENT_TABLE)).alias("table"),
            F.when(sql.isNotNull(), F.coalesce(F.upper(first_match(sql, STATEMENT_TYPE)), F.lit("OTHER"))).alias("stmt_type"),
            "duration_ms",
            F.coalesce(F.col("duration_ms") >= slow_seconds * 1000.0, F.lit(False)).alias("slow"),
            F.when(sql.isNotNull(), normalize_sql(sql)).alias("normalized"),
            F.when(event == "autovacuum", first_match(message, AUTOVACUUM)).alias("vacuum_table"),
            F.when(event == "autovacuum", F.regexp_extract(vacuum, DEAD_TUPLES, 1).try_cast("bigint")).alias("dead_tuples"),
            F.when(event == "autovacuum", F.regexp_extract(vacuum, LIVE_TUPLES, 1).try_cast("bigint")).alias("live_tuples"),
            F.when(event == "replication", first_match(message, LAG, 1)).alias("lag_value"),
            F.when(event == "replication", first_match(message, LAG, 2)).alias("lag_unit"), "zone",
        )
    )


def lag_unit(message: Column) -> Column:
    """The whole unit word after a lag value, as it is written; NULL for none or an unknown one.

    The ``lag_unit`` column takes the first unit that fits, so ``5 MB`` has ``M`` there.
    """
    return first_match(message, LAG_UNIT)


def checkpoint_numbers(entries: DataFrame) -> DataFrame:
    """Checkpoint rows with ``total_s``, ``write_s``, ``sync_s`` and ``buffers``."""
    m = F.col("message")
    return entries.where(F.col("event") == "checkpoint").select(
        "*",
        first_match(m, CHECKPOINT_TOTAL).try_cast("double").alias("total_s"),
        first_match(m, CHECKPOINT_WRITE).try_cast("double").alias("write_s"),
        first_match(m, CHECKPOINT_SYNC).try_cast("double").alias("sync_s"),
        first_match(m, CHECKPOINT_BUFFERS).try_cast("bigint").alias("buffers"),
    )
