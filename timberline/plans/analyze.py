"""Entry points: one log, a batch of logs, one timeline over several logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timberline.functions.clock import event_instant
from timberline.operators.detect import LOG_TYPES, detect_types
from timberline.operators.entries import bookkeeping, entries
from timberline.operators.once import once
from timberline.operators.parse_app import parse_api, parse_container
from timberline.operators.parse_csv import TARGETS, parse_csv
from timberline.operators.parse_database import parse_database
from timberline.operators.parse_system import parse_syslog
from timberline.operators.parse_web import parse_access, parse_error
from timberline.plans.app import API, CONTAINER
from timberline.plans.database import DATABASE
from timberline.plans.options import Options, Output
from timberline.plans.system import SYSLOG
from timberline.plans.table import TABLE
from timberline.plans.web import ACCESS, ERROR
from timberline.sources.lines import LINES_SCHEMA
from timberline.sources.scratch import scratch_dir, stored

# fixed values: names and titles of the log types
LABELS = {
    "nginx_access": "Nginx Access Log",
    "nginx_error": "Nginx Error Log",
    "container": "Container / Docker Log",
    "syslog": "Syslog / Auth Log",
    "api_backend": "API Backend Log",
    "postgres": "PostgreSQL Log",
    "csv": "CSV Log",
}
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "nginx_access": parse_access, "nginx_error": parse_error, "container": parse_container,
    "syslog": parse_syslog, "api_backend": parse_api, "postgres": parse_database, "csv": parse_csv,
}
REPORTS: dict[str, dict[str, Output]] = {
    "nginx_access": ACCESS, "nginx_error": ERROR, "container": CONTAINER, "syslog": SYSLOG,
    "api_backend": API, "postgres": DATABASE, "csv": TABLE,
}


UNDETECTED = "No log type fits the first lines (auto-detect found none): name one as log_type"


def register(log_type: str, label: str, parser: Callable[[DataFrame], DataFrame],
             outputs: dict[str, Output]) -> None:
    """Add a log type: a function ``lines -> typed DataFrame`` and its report outputs."""
    LABELS[log_type], PARSERS[log_type], REPORTS[log_type] = label, parser, outputs


def parse(lines: DataFrame, log_type: str, options: Options = Options()) -> DataFrame:
    """Typed table of lines of one type; raises ValueError for an unknown type."""
    if log_type not in PARSERS:
        raise ValueError(f"No such log type: {log_type}")
    if log_type == "postgres":
        return parse_database(lines, options.slow)
    return PARSERS[log_type](lines)


_SCHEMAS: dict[str, StructType] = {}


def typed_schema(spark: SparkSession, log_type: str) -> StructType:
    """Columns of the typed table of a log type."""
    if log_type not in _SCHEMAS:
        _SCHEMAS[log_type] = parse(spark.createDataFrame([], LINES_SCHEMA), log_type).schema
    return _SCHEMAS[log_type]


def report(parsed: DataFrame, log_type: str, options: Options = Options()) -> dict[str, DataFrame]:
    """All outputs of a report, each a DataFrame that runs when it is used.

    For many outputs write ``parsed`` to Parquet first (or persist it), so the
    lines are matched once and each output reads only its columns.
    """
    out = {"bookkeeping": bookkeeping(parsed, options.by, options.exclude)}
    out.update({name: f(parsed, options) for name, f in REPORTS[log_type].items()})
    return out


def analyze(lines: DataFrame, log_type: str = "auto", options: Options = Options()) -> dict[str, DataFrame]:
    """Report on one log. Detection looks at the first lines and runs at once.

    Several sources make one report if all of them have the same type; with
    several types ValueError points to :func:`batch`.
    """
    detected = None
    if not log_type or log_type == "auto":
        # as many rows as there are types
        kinds = detect_types(lines).where("filled").groupBy("log_type").agg(
            F.min_by(F.struct("confidence", "scores"), "source").alias("found")).select("log_type", "found.*").collect()
        names = sorted(k["log_type"] for k in kinds if k["log_type"] is not None)
        if not names:
            raise ValueError(UNDETECTED)
        if len(kinds) > 1:
            raise ValueError(f"The sources differ in type ({', '.join(names)}{' and undetected' * (len(kinds) > len(names))}): use batch")
        log_type, detected = names[0], kinds[0]
    out = report(parse(lines, log_type, options), log_type, options)
    spark = lines.sparkSession
    scores = [(x["type"], x["score"]) for x in detected["scores"]] if detected else None
    facts = [(log_type, LABELS[log_type], detected["confidence"] if detected else None, scores, list(options.exclude))]
    out["type"] = spark.createDataFrame(facts, "detected_type string, log_type_label string, detection_confidence double, "
                                               "detection_scores array<struct<type:string,score:bigint>>, excluded_ips array<string>")
    return out


def typed_sources(lines: DataFrame, log_type: str = "auto", with_scores: bool = False) -> DataFrame:
    """``(source, log_type, confidence, error)`` of every source; ``error`` says why it has no report.

    A source whose first lines are all blank counts as one without content.
    ``with_scores`` adds the points of each type and ``filled``.
    """
    empty = F.concat(F.col("source"), F.lit(" holds no lines to read"))
    found = detect_types(lines)
    if log_type and log_type != "auto":
        known = log_type in PARSERS
        problem = F.lit(None) if known else F.lit(f"No such log type: {log_type}")
        kind, sure = F.lit(log_type if known else None), F.lit(None)
    else:
        problem = F.when(F.col("log_type").isNull(), F.lit(UNDETECTED))
        kind, sure = F.col("log_type"), F.col("confidence")
    return found.select(
        "source", F.when(F.col("filled"), kind).cast("string").alias("log_type"),
        sure.cast("double").alias("confidence"),
        F.when(~F.col("filled"), empty).otherwise(problem).cast("string").alias("error"),
        *(["scores", "filled"] if with_scores else []))


def _kinds(lines: DataFrame, log_type: str) -> DataFrame:
    """:func:`typed_sources`, worked out once."""
    return stored(typed_sources(lines, log_type), scratch_dir(lines.sparkSession, "kinds"))


# Up to this many sources are named in the plan; beyond it they are joined.
_NAMED_SOURCES = 2_000


def split_by_type(lines: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """Lines of each type that occurs; ``types`` is ``(source, log_type, …)``.

    With a moderate number of sources their names become an IN filter, so a
    type reads only its own sources (a pushed filter, or partition pruning for
    a table partitioned by source). With more, the type table is semi-joined.
    """
    head = types.where(F.col("log_type").isNotNull()).select("source", "log_type").limit(_NAMED_SOURCES + 1).collect()
    if len(head) <= _NAMED_SOURCES:
        named: dict[str, list[str]] = {}
        for row in head:
            named.setdefault(row["log_type"], []).append(row["source"])
        return {t: lines.where(F.col("source").isin(*sorted(named[t]))) for t in PARSERS if t in named}
    occurring = {r["log_type"] for r in types.select("log_type").distinct().collect()}
    return {t: lines.join(types.where(F.col("log_type") == t).select("source"), "source", "left_semi")
            for t in PARSERS if t in occurring}


def batch(lines: DataFrame, log_type: str = "auto", options: Options = Options()) -> dict[str, dict[str, DataFrame]]:
    """One report per source: ``{log_type: {output: DataFrame with source}}`` and ``sources``.

    Detection runs at once. All sources of a type are aggregated together with
    ``source`` as a key, so the number of jobs does not grow with the number
    of sources.
    """
    per_source = Options(options.slow, options.critical, ("source",), options.exclude)
    kinds = _kinds(lines, log_type)
    out: dict[str, dict[str, DataFrame]] = {"sources": {"sources": kinds}}
    for t, part in split_by_type(lines, kinds).items():
        out[t] = report(parse(part, t, per_source), t, per_source)
    return out


def batch_overview(lines: DataFrame, log_type: str = "auto", options: Options = Options()) -> DataFrame:
    """One row per source: type, confidence, error, line totals and time range."""
    kinds = _kinds(lines, log_type)
    totals = None
    for t, lines_of_type in split_by_type(lines, kinds).items():
        part = bookkeeping(parse(lines_of_type, t, options), ("source",), options.exclude)
        totals = part if totals is None else totals.unionByName(part)
    out = kinds if totals is None else kinds.join(totals, "source", "left")
    return out.orderBy("source")


def compare(outputs: dict[str, DataFrame], names: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Summary figures side by side: one row per metric, one column per source."""
    table = outputs["summary"]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
    long = table.select("source", F.explode(pairs).alias("p")).select("source", "p.metric", "p.v")
    return long.groupBy("metric").pivot("source", list(sources)).agg(F.max("v")).orderBy("metric")


def shared_clients(entries_by_source: DataFrame, client: str = "ip") -> DataFrame:
    """Clients seen in more than one source: ``(client, sources, rows)``."""
    per = entries_by_source.where(F.col(client).isNotNull()).groupBy(client, "source").agg(F.count("*").alias("_n"))
    return per.groupBy(F.col(client).alias("client")).agg(
        F.count("*").alias("sources"), F.sum("_n").alias("rows")).where(F.col("sources") > 1).orderBy(
        F.col("sources").desc(), F.col("rows").desc(), "client")


def entry_summary(log_type: str) -> Column:
    """One-line text of an entry for the timeline."""
    c = F.col
    if log_type == "nginx_access":
        return F.concat(c("method"), F.lit(" "), c("path"), F.lit(" → "), c("status").cast("string"))
    if log_type == "nginx_error":
        return c("message")
    if log_type == "syslog":
        return F.concat(c("process"), F.lit(": "), c("message"))
    if log_type == "container":
        return F.concat(F.lit("["), c("stream"), F.lit("] "), c("message"))
    if log_type in ("api_backend", "postgres"):
        return F.concat(c("level"), F.lit(": "), c("message"))
    return F.left(c("entry"), F.lit(120))


_NOT_IN_ENTRY = ("source", "line_no", "is_header", "mapped", "header_names", "trace_line", "zone", "day",
                 "vacuum_table", "dead_tuples", "live_tuples", "lag_value", "lag_unit")


def timeline_rows(parsed: DataFrame, log_type: str, exclude: Sequence[str] = (), by_time: bool = False,
                  year: int | None = None) -> DataFrame:
    """Entries of one type in the common timeline form; ``entry`` is JSON text.

    ``by_time`` adds ``instant``, the time in UTC by the zone that the entry gives; times
    without a year take ``year``.
    """
    e = entries(parsed, exclude)
    body = F.to_json(F.struct(*[n for n in e.columns if n not in _NOT_IN_ENTRY]))
    zone = F.col("zone") if "zone" in e.columns else None
    e = e.withColumn("entry", body)
    if by_time:
        e = once(once(e, _stamp=F.col("timestamp")), _instant=event_instant(F.col("_stamp"), zone, year=year))
    return e.select(
        F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.lit(log_type).alias("type"), "source",
        entry_summary(log_type).alias("summary"), "entry", "line_no",
        *([F.col("_instant").alias("instant")] if by_time else []))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns; raises ValueError when there is none."""
    if not parts:
        raise ValueError("No source has a log type: nothing to correlate")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def timeline_order(by_time: bool) -> list[str]:
    return ["instant" if by_time else "timestamp", "place", "line_no"]


def in_order(rows: DataFrame, places: DataFrame, by_time: bool = False) -> DataFrame:
    """Timeline rows by timestamp text (or instant), then the place ``(source, place)`` of their source, then line.

    Entries without a time come first.
    """
    return rows.join(places, "source").orderBy(*timeline_order(by_time))


def places_of(lines: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``(source, place)``: the named sources in the given order, others after them by name."""
    named = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("source")) if order else F.lit(0)
    last = F.when(named == 0, F.lit(len(order) + 1)).otherwise(named)
    ranked = W.orderBy(last, "source")
    return lines.select("source").distinct().withColumn("place", F.row_number().over(ranked).cast("bigint") - 1)


def correlate(lines: DataFrame, log_type: str = "auto", options: Options = Options(),
              known: DataFrame | None = None, order: Sequence[str] = (), by_time: bool = False, year: int | None = None) -> DataFrame:
    """Entries of all sources in one timeline, by timestamp text, then source, then line.

    ``order`` names the sources in the order of their files, which decides
    between entries of equal times; sources that it does not name follow by name. ``by_time``
    sorts by the instant that the zone of each entry gives instead of the text. Sources without a
    detected type are left out. ``known`` gives types by
    source ``(source, log_type)`` instead of detection. Raises ValueError when
    no source has a type.
    """
    types = _kinds(lines, log_type) if known is None else known
    rows = union([timeline_rows(parse(part, t, options), t, options.exclude, by_time, year) for t, part in split_by_type(lines, types).items()])
    if not order:
        return rows.orderBy("instant" if by_time else "timestamp", "source", "line_no")
    return in_order(rows, places_of(types, order), by_time).drop("place")


def timeline_totals(timeline: DataFrame) -> DataFrame:
    """One row: events and sources of a timeline."""
    return timeline.groupBy("source").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_events"), F.count("*").alias("sources"))


def type_counts(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("type").agg(F.count("*").alias("events"))


__all__ = ["LABELS", "LOG_TYPES", "PARSERS", "REPORTS", "TARGETS", "analyze", "batch", "batch_overview", "compare",
           "correlate", "in_order", "parse", "places_of", "register", "report", "shared_clients", "split_by_type", "timeline_rows", "timeline_totals",
           "type_counts", "typed_sources"]
