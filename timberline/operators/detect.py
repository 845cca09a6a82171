"""Log-type detection for all sources in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.numeric import round_exact
from timberline.functions.text import csv_fields, strip

SAMPLE_LINES = 50

# fixed values: markers per log type; order decides ties
MARKERS = {
    "nginx_access": [
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+\S+\s+\S+\s+\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    ],
    "nginx_error": [
        r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[\w+\]\s+\d+#\d+:",
    ],
    "container": [
        r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+z?\s+(stdout|stderr)",
    ],
    "syslog": [
        r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+(\[\d+\])?:",
        r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*\s+\S+\s+\S+(\[\d+\])?:",
    ],
    "postgres": [
        r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+\S+\s+\[\d+\]\s+(?:LOG|WARNING|ERROR|FATAL|PANIC):",
        r"duration:\s*[\d.]+\s*ms\s+statement:",
        r"checkpoint (?:starting|complete):",
        r"database system (?:is ready|was)",
    ],
    "api_backend": [
        r"^\{",
        r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}",
    ],
    "csv": [
        r'^"?[a-zA-Z_][a-zA-Z0-9_]*"?\s*,\s*"?[a-zA-Z_][a-zA-Z0-9_]*"?\s*,\s*"?[a-zA-Z_][a-zA-Z0-9_]*"?',
        # four fields; the form tells no more, and a counted group of possessive parts is matched without recursion
        r'^(?:"[^"]*+"\s*+|[^",]++)(?:,(?:\s*+"[^"]*+"\s*+|[^",]++)){3}',
    ],
}
LOG_TYPES = list(MARKERS)
_IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


def _matches(text: Column, log_type: str) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in MARKERS[log_type]))


def detect_types(lines: DataFrame, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """One row per source: ``source, log_type, confidence, scores, filled``.

    Each of the first lines of a source gives a point to every type with a
    marker in it. CSV points count only if the first line is a header and the
    next rows have its number of fields. The best type needs two points and a
    tenth of the sample; otherwise ``log_type`` is NULL. ``scores`` lists the
    types with points, in the fixed order; ``filled`` tells whether the sample has any text.

    Only the sample lines leave the scan, at most ``sample_lines`` per source.
    """
    text = F.col("_text")
    fields = csv_fields(text)
    no = F.col("line_no")
    sample = lines.where(no < sample_lines).select(
        "source", "line_no", strip(F.col("value")).alias("_text"))
    scored = sample.select(
        "source", "line_no", (text == "").alias("_blank"),
        *[F.when((text != "") & _matches(text, t), 1).otherwise(0).alias(t) for t in LOG_TYPES],
        F.when(no == 0, F.transform(fields, strip)).alias("_header"),
        F.when((no > 0) & (no <= 10) & (text != ""), F.size(fields)).alias("_width"),
    )
    per_source = scored.groupBy("source").agg(
        F.count("*").alias("_n"), F.bool_or(~F.col("_blank")).alias("filled"), *[F.sum(t).alias(t) for t in LOG_TYPES],
        F.max("_header").alias("_header"),
        # at most ten small numbers per source
        F.collect_list("_width").alias("_widths"),
    )
    width = F.size("_header")
    names = F.size(F.filter("_header", lambda h: h.rlike(_IDENTIFIER)))
    same = F.size(F.filter("_widths", lambda w: w == width))
    is_csv = (F.col("_n") >= 2) & (width >= 2) & (names >= width * 0.5) & (same >= F.least(F.lit(3), F.col("_n") - 1))
    points = [F.col(t) if t != "csv" else F.when(F.coalesce(is_csv, F.lit(False)), F.col("csv")).otherwise(0)
              for t in LOG_TYPES]
    ranked = F.array(*[
        F.struct(p.cast("bigint").alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type"))
        for i, (t, p) in enumerate(zip(LOG_TYPES, points))])
    best = F.array_max("_ranked")
    ok = (best["score"] >= 2) & (best["score"] >= F.col("_n") * 0.1)
    return per_source.select("source", "_n", "filled", ranked.alias("_ranked")).select(
        "source", F.when(ok, best["type"]).alias("log_type"),
        F.when(ok, round_exact(F.least(F.lit(1.0), best["score"] / F.col("_n")), 2)).otherwise(0.0).alias("confidence"),
        F.transform(F.filter("_ranked", lambda r: r["score"] > 0),
                    lambda r: F.struct(r["type"].alias("type"), r["score"].alias("score"))).alias("scores"),
        "filled",
    )
