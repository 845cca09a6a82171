"""Header-row CSV lines -> rows with ten canonical columns.

Headers are mapped inside Spark: each source's first line becomes an array of
names and a map ``target -> position``; rows join their header by source and
take their values by position. So sources with any number of different
headers give one DataFrame with one schema; headers that are no canonical
column end up in the ``extra`` map under their own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import csv_fields, strip
from timberline.operators.once import once

# fixed values: canonical columns and the header names they go by, in order
COLUMN_NAMES = {
    "timestamp": ["timestamp", "time", "date", "created_at", "occurred_at", "ts",
                  "@timestamp", "datetime", "log_date", "event_time", "event_timestamp",
                  "accessed_on", "request_time", "logged_at", "emitted_at"],
    "level": ["level", "severity", "log_level", "logtype", "loglevel"],
    "message": ["message", "msg", "description", "error", "details", "log", "text", "body"],
    "ip": ["ip", "source_ip", "client_ip", "src_ip", "remote_addr", "client",
           "remote_ip", "src", "host_ip", "http_x_forwarded_for",
           "x_forwarded_for", "forwarded_for", "requester_ip"],
    "endpoint": ["endpoint", "path", "url", "request_uri", "uri", "request_path",
                 "url_path", "route", "api_path", "request_url"],
    "method": ["method", "http_method", "verb"],
    "status": ["status", "status_code", "http_code", "response_code", "code"],
    "duration": ["duration", "response_time", "rt", "latency", "elapsed",
                 "request_time", "upstream_response_time", "processing_time"],
    "bytes": ["bytes", "body_bytes", "size", "bytes_sent", "response_size", "content_length"],
    "user": ["user", "username", "user_name", "auth_user", "uuid",
             "user_id", "accessed_by_id"],
}
TARGETS = list(COLUMN_NAMES)

# Header text up to this size is broadcast; split into names and positions it grows about tenfold.
_BROADCAST_BYTES = 16 << 20


def _target_of(header: Column) -> Column:
    """Canonical column a header name stands for; the first in order wins."""
    norm = F.translate(F.lower(strip(header)), " -", "__")
    out = None
    for target, names in COLUMN_NAMES.items():
        cond = norm.isin(*names)
        out = F.when(cond, target) if out is None else out.when(cond, target)
    return out


def map_headers(headers: DataFrame) -> DataFrame:
    """Work out the columns of ``(…, names ARRAY)``, once per header.

    Adds ``positions`` (index of each canonical column), ``own`` (name and
    index of the other columns), ``result_at`` (index of ``results``) and
    ``mapped`` (canonical columns present).

    When several headers stand for one target the longest wins, then the first
    in text order. A loser keeps its own name; if that is a canonical name it
    becomes ``<name>_raw`` so that it cannot overwrite the winner. Of several
    headers with one name the last counts.
    """
    candidates = F.transform("names", lambda h, i: F.struct(
        _target_of(h).alias("target"), (-F.length(h)).alias("order"), h.alias("name"), i.alias("pos")))

    def winner(target: str) -> Column:
        best = F.array_min(F.transform(
            F.filter("_cand", lambda c: c["target"] == target),
            lambda c: F.struct(c["order"].alias("o"), c["name"].alias("n"), c["pos"].alias("p"))))
        return best["p"].alias(target)

    own = F.filter(
        F.transform("names", lambda h, i: F.struct(
            F.when(h.isin(*TARGETS), F.concat(h, F.lit("_raw"))).otherwise(h).alias("key"), i.alias("pos"))),
        lambda e: ~F.array_contains("_won", e["pos"]))
    # in order of name and place the last of a name stands before another name; then back in order of place
    last_own = F.filter("_sorted", lambda e, i: ~F.coalesce(F.get("_sorted", i + 1)["key"] == e["key"], F.lit(False)))
    placed = F.transform("own", lambda e: F.struct(e["pos"].alias("pos"), e["key"].alias("key")))
    at = F.transform(F.filter("own", lambda e: e["key"] == "results"), lambda e: e["pos"])
    return (
        headers.withColumn("_cand", candidates)
        .withColumn("positions", F.struct(*[winner(t) for t in TARGETS]))
        .withColumn("_won", F.array_compact(F.array(*[F.col(f"positions.{t}") for t in TARGETS])))
        .withColumn("_own", own).withColumn("_sorted", F.array_sort("_own")).withColumn("own", last_own)
        .withColumn("own", F.transform(F.array_sort(placed), lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos"))))
        .withColumn("result_at", F.get(at, F.lit(0)))
        .withColumn("mapped", F.array_compact(F.array(*[
            F.when(F.col(f"positions.{t}").isNotNull(), F.lit(t)) for t in TARGETS])))
        .drop("_cand", "_won", "_own", "_sorted")
    )


def read_headers(lines: DataFrame) -> DataFrame:
    """First line of each source, with its columns worked out; ``lines`` may hold other lines too."""
    first = once(lines.where(F.col("line_no") == 0).select("source", strip(F.col("value")).alias("_text")),
                 names=F.transform(csv_fields(F.col("_text")), strip))
    return map_headers(first.select("source", "names"))


def header_bytes(lines: DataFrame) -> int:
    """Bytes of the first lines of all sources and of their names."""
    held = lines.where(F.col("line_no") == 0).agg(F.sum(
        F.coalesce(F.octet_length("value"), F.lit(0)) + F.octet_length("source")).alias("n"))
    return held.first()["n"] or 0


def _result_level(raw: Column) -> Column:
    """Level and message told by a ``results`` value, first rule wins."""
    # fixed values: patterns, level words and messages of the rules
    error_y = F.regexp_extract(raw, r"'error':\s*'([^']*)'", 1)
    error = F.regexp_extract(raw, r"'error':\s*'([^']+)'", 1)
    detail, field = r"'detail':\s*ErrorDetail\(string='([^']*)'", r"'non_field_errors':\s*\[ErrorDetail\(string='([^']*)'"

    def found(level: str, message: Column | str) -> Column:
        m = F.lit(message) if isinstance(message, str) else message
        return F.struct(F.lit(level).alias("level"), m.alias("message"))

    yes = F.contains(raw, F.lit("'matched': 'Y'")) | F.contains(raw, F.lit("'matched': \"Y\""))
    no = F.contains(raw, F.lit("'matched': 'N'")) | F.contains(raw, F.lit("'matched': \"N\""))
    return (
        F.when(yes, found("INFO", "Match found"))
        .when(no, found("WARN", F.when(raw.rlike(r"'error':\s*'[^']*'"), error_y).otherwise("No match")))
        .when(error != "", found("ERROR", error))
        .when(raw.rlike(detail), found("ERROR", F.regexp_extract(raw, detail, 1)))
        .when(raw.rlike(field), found("ERROR", F.regexp_extract(raw, field, 1)))
        .when(F.contains(F.lower(raw), F.lit("'token'")), found("INFO", "Token issued"))
        .when(raw.isNotNull(), found("INFO", F.left(raw, F.lit(200))))
    )


def parse_csv(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """CSV rows of all sources, each read by the header of its own source.

    Short rows are padded with NULL, blank fields are NULL, rows without any
    value are unparsed; the header line itself has ``is_header``. The header
    table has one row per source. A job that reads the first lines measures it
    at once: up to ``_BROADCAST_BYTES`` of text it is broadcast, so that no other
    text is shuffled; beyond that the rows are joined by source. ``heads``, lines
    with the first one of each source, spares reading all lines for that.
    """
    heads = lines if heads is None else heads
    headers = read_headers(heads).where(F.size("names") >= 2)
    if header_bytes(heads) <= _BROADCAST_BYTES:
        headers = F.broadcast(headers)
    text, f = F.col("_text"), F.col("_f")
    joined = lines.select("source", "line_no", strip(F.col("value")).alias("_text")).join(headers, "source", "left")
    has_header = F.col("names").isNotNull()
    is_row = has_header & (F.col("line_no") > 0) & (text != "")
    rows = once(
        joined, is_header=(F.col("line_no") == 0) & has_header,
        _f=F.when(is_row, F.slice(csv_fields(text), F.lit(1), F.size("names"))))

    def cell(at: Column) -> Column:
        return F.nullif(strip(F.get(f, at)), F.lit(""))

    told = F.when(F.col("positions.level").isNull() & F.col("_result").isNotNull(), _result_level(F.col("_result")))
    typed = rows.select(
        "*", *[cell(F.col(f"positions.{t}")).alias(t) for t in TARGETS], cell(F.col("result_at")).alias("_result"),
    ).withColumn("_told", told)
    others = [t for t in TARGETS if t not in ("level", "message")]
    extra = F.map_from_arrays(F.transform("own", lambda e: e["key"]), F.transform("own", lambda e: cell(e["pos"])))
    return typed.select(
        "source", "line_no", "is_header",
        F.coalesce(strip(F.array_join(f, "")) != "", F.lit(False)).alias("parsed"),
        ((text == "") & ~F.col("is_header")).alias("blank"),
        *[F.col(t) for t in others],
        F.coalesce("_told.level", "level").alias("level"), F.coalesce("_told.message", "message").alias("message"),
        F.when(f.isNotNull(), extra).alias("extra"), "mapped", F.col("names").alias("header_names"),
    )
