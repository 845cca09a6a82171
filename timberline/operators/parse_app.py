"""Container lines and API lines (JSON or text) -> typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.numeric import to_float, to_int
from timberline.functions.rules import level_from_words
from timberline.functions.text import capture, first_match, group, group_or_null, strip
from timberline.operators.once import once

# fixed values: line forms
CONTAINER_LINE = (
    r"(?s)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)\s+(stdout|stderr)(?:\s+([A-Z]))?\s+(.+)\z"
)
CONTAINER_FALLBACK = r"^(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2})"
API_TEXT = (
    r"(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
    r'\s+(?:\[(\w+)\]|"level":\s*"(\w+)"|(ERROR|WARN|INFO|DEBUG|FATAL))'
)

# fixed values: names under which a JSON line may carry a field, in order
JSON_NAMES = {
    "level": ["level", "severity", "loglevel", "log_level", "lvl"],
    "timestamp": ["timestamp", "time", "ts", "@timestamp", "date"],
    "message": ["message", "msg", "log", "error"],
    "method": ["method", "http_method", "req_method"],
    "path": ["path", "url", "uri", "endpoint"],
    "request_id": ["request_id", "req_id", "trace_id"],
    "status": ["status"],
    "duration": ["duration"],
}


def parse_container(lines: DataFrame) -> DataFrame:
    """``time stream [flag] message``, else any longer line that opens with a time."""
    text, g = F.col("_text"), F.col("_g")
    plain_time = F.when(F.length(text) > 20, first_match(text, CONTAINER_FALLBACK))
    typed = group(g, 4).isNotNull()
    message = F.when(typed, group(g, 4)).when(F.col("_plain").isNotNull(), text)
    read = once(lines.select("source", "line_no", strip(F.col("value")).alias("_text")),
                _g=capture(text, CONTAINER_LINE, 4), _plain=plain_time)
    levelled = once(read.select("*", message.alias("message")), level=F.when(
        F.col("message").isNotNull(), level_from_words(F.col("message"))))
    is_plain = typed.isNull() | ~typed
    return levelled.select(
        "source", "line_no",
        F.col("message").isNotNull().alias("parsed"), (text == "").alias("blank"),
        F.when(is_plain, F.col("_plain")).otherwise(F.replace(group(g, 1), F.lit("Z"), F.lit(""))).alias("timestamp"),
        F.when(typed, group(g, 2)).when(F.col("_plain").isNotNull(), "stdout").alias("stream"),
        F.when(typed, group_or_null(g, 3)).alias("flag"),
        "level", "message",
    )


# fixed values: JSON texts that count as not set unless they are quoted
UNSET_TEXTS = ["0", "0.0", "-0.0", "false", "[]", "{}"]


def _quoted(name: str) -> Column:
    """Whether the JSON value is a string; ``_typed`` is there for the few rows where it matters."""
    return F.schema_of_variant(F.try_variant_get("_typed", f'$["{name}"]', "variant")) == "STRING"


def _set_value(fields: Column, name: str) -> Column:
    """JSON value as text unless it is null, empty, zero or false (a quoted "0" counts)."""
    text = F.try_element_at(fields, F.lit(name))
    empty = text.isin(*UNSET_TEXTS)
    return F.when(text == "", F.lit(None)).when(empty & ~_quoted(name), F.lit(None)).otherwise(text)


def _first_set(fields: Column, field: str) -> Column:
    return F.coalesce(*[_set_value(fields, n) for n in JSON_NAMES[field]])


def parse_api(lines: DataFrame) -> DataFrame:
    """JSON objects with aliased fields, or text with a time and a level somewhere.

    Values that are objects or lists come out as JSON text; ``extra`` holds the
    keys that are no known field.
    """
    text, doc, g = F.col("_text"), F.col("_doc"), F.col("_g")
    is_json = F.startswith(text, F.lit("{"))
    known = [n for names in JSON_NAMES.values() for n in names]

    # whole numbers read the same quoted or not; only other texts need the JSON type
    status_text = F.try_element_at(doc, F.lit("status"))
    status = F.coalesce(
        to_int(status_text),
        F.when(status_text.isNull() | _quoted("status"), F.lit(None).cast("bigint"))
        .when(status_text.isin("true", "false"), F.when(status_text == "true", 1).otherwise(0))
        .otherwise(to_float(status_text).try_cast("bigint")),
    )
    duration_text = F.try_element_at(doc, F.lit("duration"))
    duration = F.when(duration_text.isin("true", "false"), F.when(duration_text == "true", 1.0).otherwise(0.0)) \
        .otherwise(to_float(duration_text))

    spoken = F.coalesce(group_or_null(g, 2), group_or_null(g, 3), group_or_null(g, 4))
    base = once(
        lines.select("source", "line_no", strip(F.col("value")).alias("_text")),
        _doc=F.when(is_json, F.from_json(text, "map<string,string>")),
        _g=F.when(~is_json, capture(text, r"(?s)^.*?" + API_TEXT + r".*\z", 4)),
    )
    # the map of texts does not tell 0 from "0"; rows where that decides are read once more with types
    unsure = F.arrays_overlap(F.map_values(doc), F.array(*[F.lit(t) for t in UNSET_TEXTS])) | (
        status_text.isNotNull() & to_int(status_text).isNull())
    base = once(base, _typed=F.when(unsure, F.try_parse_json(text)))
    from_json, from_text = doc.isNotNull(), group(g, 1).isNotNull()
    return base.select(
        "source", "line_no",
        F.coalesce(from_json | from_text, F.lit(False)).alias("parsed"), (text == "").alias("blank"),
        F.when(from_json, F.coalesce(_first_set(doc, "timestamp"), F.lit(""))).otherwise(group(g, 1)).alias("timestamp"),
        F.when(from_json, F.lower(F.coalesce(_first_set(doc, "level"), F.lit("info"))))
        .when(from_text, F.lower(F.coalesce(spoken, F.lit("info")))).alias("level"),
        F.when(from_json, _first_set(doc, "method")).alias("method"),
        F.when(from_json, _first_set(doc, "path")).alias("path"),
        F.when(from_json, status).alias("status"),
        F.when(from_json, duration).alias("duration"),
        F.when(from_json, F.coalesce(_first_set(doc, "message"), F.lit(""))).when(from_text, text).alias("message"),
        F.when(from_json, _first_set(doc, "request_id")).alias("request_id"),
        F.when(from_json, F.map_filter(doc, lambda k, _: ~k.isin(*known)))
        .when(from_text, F.create_map().cast("map<string,string>")).alias("extra"),
    )
