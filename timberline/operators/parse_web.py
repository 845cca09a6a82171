"""Web-server access and error lines -> typed entries.

Every parse operator is a narrow projection over ``lines``: no shuffle, no
Python per row. The output keeps one row per input line with ``parsed`` and
``blank`` flags, so the bookkeeping totals come from the same table;
:func:`timberline.operators.entries.entries` keeps the parsed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.clock import access_time, error_time
from timberline.functions.numeric import to_int
from timberline.functions.text import capture, first_match, group, group_or_null, strip
from timberline.operators.once import once

# fixed values: line forms
ACCESS_LINE = (
    r'(?s)^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\S+)'
    r'(?:( "[^"]*")( "[^"]*"))?'
    r"(?: rt=(\d+(?:\.\d+)?))?(?: urt=(\d+(?:\.\d+)?))?"
    r"(?: uht=(\d+(?:\.\d+)?))?(?: uct=(\d+(?:\.\d+)?))?.*\z"
)
ERROR_LINE = (
    r"(?s)^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+):(?: \*(\d+))? (.+)\z"
)
NAMED_CLIENT = r"client:\s*(\S+)"
ANY_ADDRESS = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def _unquoted(part):
    """`` "text"`` -> ``text``; '' (group absent) -> NULL."""
    return F.when(F.length(part) > 0, F.substr(part, F.lit(3), F.length(part) - 3))


def _with_groups(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    text = lines.select("source", "line_no", strip(F.col("value")).alias("_text"))
    return once(text, _g=capture(F.col("_text"), pattern, groups))


def parse_access(lines: DataFrame) -> DataFrame:
    """Combined access format with optional referrer, agent and upstream timings.

    A byte count of ``-`` is 0; one that is no number makes the line unparsed.
    ``timestamp`` has no zone; ``zone`` is what the line gives (``+0500``).
    """
    g = F.col("_g")
    size = F.when(group(g, 7) == "-", F.lit(0).cast("bigint")).otherwise(to_int(group(g, 7)))
    return _with_groups(lines, ACCESS_LINE, 13).select(
        "source", "line_no",
        size.isNotNull().alias("parsed"), (F.col("_text") == "").alias("blank"),
        group(g, 1).alias("ip"), access_time(group(g, 2)).alias("timestamp"),
        group(g, 3).alias("method"), group(g, 4).alias("path"), group(g, 5).alias("protocol"),
        group(g, 6).try_cast("int").alias("status"), size.alias("bytes"),
        _unquoted(group(g, 8)).alias("referrer"), _unquoted(group(g, 9)).alias("user_agent"),
        group_or_null(g, 10).try_cast("double").alias("response_time"),
        group_or_null(g, 11).try_cast("double").alias("upstream_response_time"),
        group_or_null(g, 12).try_cast("double").alias("upstream_header_time"),
        group_or_null(g, 13).try_cast("double").alias("upstream_connect_time"),
        first_match(group(g, 2), r"\s([+-]\d{4})$").alias("zone"),
    )


def parse_error(lines: DataFrame) -> DataFrame:
    """Web-server error format; the client is named or the first address in the message."""
    g = F.col("_g")
    message = group(g, 6)
    client = F.coalesce(first_match(message, NAMED_CLIENT), first_match(message, ANY_ADDRESS))
    return _with_groups(lines, ERROR_LINE, 6).select(
        "source", "line_no",
        message.isNotNull().alias("parsed"), (F.col("_text") == "").alias("blank"),
        error_time(group(g, 1)).alias("timestamp"), group(g, 2).alias("level"),
        group(g, 3).try_cast("bigint").alias("pid"), group(g, 4).try_cast("bigint").alias("tid"),
        group_or_null(g, 5).try_cast("bigint").alias("cid"),
        F.rtrim(client, F.lit(",")).alias("client"), message.alias("message"),
    )
