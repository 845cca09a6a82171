"""Syslog lines -> typed entries, with kernel traces folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import rules
from timberline.functions.text import capture, first_match, group, group_or_null, strip
from timberline.operators.once import once
from timberline.operators.positions import BLOCK_LINES, last_before

# fixed values: line form; the time is RFC 3339 or BSD
SYSLOG_LINE = (
    r"(?s)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2})?"
    r"|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
    r"\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)\z"
)


def mark_traces(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Lines with ``starts_trace`` and ``trace_line`` (NULL outside a trace).

    A trace starts at a parsed kernel line with a start word. Lines after it
    that could continue it (no start word, ``kernel:`` in them, first
    character not a capital) belong to it and are no entries; the first other
    line ends it. So a line is swallowed if it could continue a trace and the
    latest line before it that could not is a trace start: a carry of one
    value along the source, done block by block.

    ``trace_line`` is the line number of the start for swallowed lines.

    Lines that cannot continue a trace pass without a shuffle. For the carry
    they send only their number and mark; the text of the other lines goes along.
    """
    text = F.col("_text")
    has_word = rules.any_text(F.col("_low"), rules.TRACE_START)
    g = capture(text, SYSLOG_LINE, 5)
    first = F.left(text, F.lit(1))
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    # the full line pattern is tried only on lines with a start word
    starts = F.when(has_word, F.coalesce(
        (rules.service_category(group(g, 3)) == "kernel") & rules.any_text(F.lower(group(g, 5)), rules.TRACE_START), F.lit(False)
    )).otherwise(False)
    could_continue = ~has_word & F.contains(text, F.lit("kernel:")) & ~capital
    marked = once(
        once(lines.select("source", "line_no", strip(F.col("value")).alias("_text")), _low=F.lower("_text")),
        starts_trace=starts, _cont=F.coalesce(could_continue, F.lit(False)),
    ).drop("_low")
    numbered = F.col("source").isNotNull() & F.col("line_no").isNotNull()
    plain = marked.where(numbered & ~F.col("_cont")).select(
        "source", "line_no", "_text", "starts_trace", F.lit(None).cast("bigint").alias("trace_line"))
    fence = F.when((text != "") & ~F.col("_cont"), F.when(F.col("starts_trace"), F.col("line_no")).otherwise(F.lit(-1)))
    slim = marked.select("source", "line_no", F.when(F.col("_cont"), text).alias("_text"), fence.cast("bigint").alias("_v"))
    carried = last_before(slim, F.col("_v"), "_fence", block_lines).where(F.col("_text").isNotNull())
    return plain.unionByName(carried.select(
        "source", "line_no", "_text", F.lit(False).alias("starts_trace"),
        F.when(F.col("_fence") >= 0, F.col("_fence")).alias("trace_line")))


def parse_syslog(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """RFC 3339 or BSD syslog lines with severity, category, auth and anomaly findings.

    Only raw text that could continue a trace is shuffled; all text is parsed
    after that. ``trace_line_count`` is 1 for a trace start; ``trace_line`` on swallowed
    lines allows counting the lines of each trace.
    """
    g, text = F.col("_g"), F.col("_text")
    message, process = group(g, 5), group(g, 3)
    split = once(mark_traces(lines, block_lines),
                 _g=F.when(F.col("trace_line").isNull(), capture(text, SYSLOG_LINE, 5)))
    found = once(
        split.select(
            "source", "line_no", "trace_line", "starts_trace", (text == "").alias("blank"),
            group(g, 1).alias("timestamp"), group(g, 2).alias("hostname"), process.alias("process"),
            group_or_null(g, 4).try_cast("bigint").alias("pid"), message.alias("message"),
            F.lower(message).alias("_low"),
        ),
        _named=rules.syslog_severity(F.col("message"), F.col("_low")),
        is_auth_failure=rules.is_auth_failure(F.col("message"), F.col("_low")),
        _rule=rules.anomaly_rule(F.col("message"), F.col("_low")),
    )
    return (
        found
        .withColumn("severity", F.when(F.col("message").isNull(), F.lit(None))
                    .when(F.col("is_auth_failure") & (F.col("_named") == "INFO"), "WARN")
                    .otherwise(F.col("_named")))
        .select(
            "source", "line_no", F.col("message").isNotNull().alias("parsed"), "blank",
            "timestamp", "hostname", "process", "pid", "message", "severity",
            F.when(F.col("message").isNotNull(), rules.service_category(F.col("process"))).alias("category"),
            "is_auth_failure",
            first_match(F.col("message"), rules.SOURCE_IP).alias("source_ip"),
            first_match(F.col("message"), rules.TARGET_USER).alias("user"),
            F.when(F.col("starts_trace"), 1).otherwise(0).alias("trace_line_count"),
            F.coalesce(rules.anomaly_type(F.col("_rule"), F.col("message"), F.col("severity")),
                       F.when(F.col("starts_trace"), "kernel_trace_block")).alias("anomaly_type"),
            rules.anomaly_detail(F.col("_rule"), F.col("message"), F.col("process"), F.col("severity"))
            .alias("anomaly_detail"),
            "trace_line",
        )
    )


def trace_sizes(parsed: DataFrame) -> DataFrame:
    """Swallowed lines per trace start: ``(source, line_no, swallowed)``."""
    return (
        parsed.where(F.col("trace_line").isNotNull())
        .groupBy("source", F.col("trace_line").alias("line_no")).agg(F.count("*").alias("swallowed"))
    )
