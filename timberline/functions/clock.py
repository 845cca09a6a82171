"""Timestamp text: web-server times to ISO form, hour and day keys, real timestamps.

Timestamps stay text and are compared as text, zone dropped, as the reports
define them. :func:`event_time` and :func:`event_hour` give true time values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: month names in order
MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"


def _two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _month(name: Column) -> Column:
    """Month name -> ``01``..``12``, an unknown name -> ``00``."""
    return _two_digits(F.call_function("find_in_set", name, F.lit(MONTHS)))


def _words(ts: Column) -> Column:
    """Words of a timestamp text (a single-blank split needs no regex per row)."""
    return F.split(F.regexp_replace(F.trim(ts), r"\s+", " "), " ")


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def access_time(ts: Column) -> Column:
    """``18/Jul/2025:14:30:00 +0500`` -> ``2025-07-18T14:30:00``; other text unchanged."""
    text = F.trim(F.translate(ts, "\t", " "))
    date = F.substring_index(text, " ", 1)
    day = F.substring_index(date, "/", 1)
    month = F.substring_index(F.substring_index(date, "/", 2), "/", -1)
    last = F.substring_index(date, "/", -1)
    joined = F.instr(last, ":") > 0
    year = F.substring_index(last, ":", 1)
    time = F.when(joined, F.substr(last, F.instr(last, ":") + 1)).otherwise(F.get(_words(text), F.lit(1)))
    iso = F.concat(
        year, F.lit("-"), _month(month), F.lit("-"), _two_digits(day.try_cast("int")), F.lit("T"), time)
    ok = (F.instr(text, " ") > 0) & (_slashes(date) == 2) & day.rlike("^[0-9]{1,9}$")
    return F.when(ok, iso).otherwise(ts)


def error_time(ts: Column) -> Column:
    """``2025/07/18 14:30:00`` or ``18/Jul/2025 14:30:00`` -> ISO text; other text unchanged."""
    text = F.trim(F.translate(ts, "\t", " "))
    date = F.substring_index(text, " ", 1)
    parts = F.split(date, "/")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    time = F.get(_words(text), F.lit(1))
    year_first = F.concat(
        a, F.lit("-"), _two_digits(b.try_cast("int")), F.lit("-"), _two_digits(c.try_cast("int")), F.lit("T"), time)
    day_first = F.concat(c, F.lit("-"), _month(b), F.lit("-"), _two_digits(a.try_cast("int")), F.lit("T"), time)
    iso = F.when(a.rlike("^[0-9]{4}$"), year_first).otherwise(day_first)
    ok = (F.instr(text, " ") > 0) & (_slashes(date) == 2)
    return F.when(ok, F.coalesce(iso, ts)).otherwise(ts)


def _date_t_time(ts: Column) -> Column:
    """A ``T`` separates date and time only when it follows a digit (``UTC`` does not)."""
    return ts.rlike(r"^[^T\s]*[0-9]T")


def hour_key(ts: Column) -> Column:
    """Label of the hour: ``2025-07-18 14:00`` for ISO text, ``14:00`` otherwise.

    Text with a blank between date and time loses the date, so its days fold
    together; use :func:`event_hour` where that is not wanted.
    """
    after = F.get(F.split(ts, "T"), F.lit(1))
    hour = F.when(F.length(after) >= 2, F.left(after, F.lit(2))).otherwise("00")
    iso = F.concat(F.substring_index(ts, "T", 1), F.lit(" "), hour, F.lit(":00"))
    words = _words(ts)
    clock = F.when(F.size(words) >= 3, F.get(words, F.lit(2))).when(F.size(words) == 2, F.get(words, F.lit(1)))
    bare = F.when(F.length(clock) >= 2, F.concat(F.left(clock, F.lit(2)), F.lit(":00")))
    return F.coalesce(F.when(_date_t_time(ts), iso).otherwise(bare), F.lit("unknown"))


def database_hour_key(ts: Column) -> Column:
    """Hour label that keeps the date for both separators."""
    after = F.substr(ts, F.instr(ts, "T") + 1)
    iso_hour = F.when(F.length(after) >= 2, F.left(after, F.lit(2))).otherwise("00")
    iso = F.concat(F.substring_index(ts, "T", 1), F.lit(" "), iso_hour, F.lit(":00"))
    words = _words(ts)
    second = F.get(words, F.lit(1))
    hour = F.when(F.length(second) >= 2, F.left(second, F.lit(2))).otherwise("00")
    bare = F.when(F.size(words) >= 2, F.concat(F.get(words, F.lit(0)), F.lit(" "), hour, F.lit(":00")))
    return F.coalesce(F.when(_date_t_time(ts), iso).otherwise(bare), F.lit("unknown"))


def day_key(ts: Column) -> Column:
    """Label of the day, ``unknown`` when the text has no ISO date in front."""
    words = _words(ts)
    first = F.get(words, F.lit(0))
    dashes = F.length(first) - F.length(F.replace(first, F.lit("-"), F.lit("")))
    bare = (
        F.when((F.size(words) >= 3) & (dashes >= 2), first)
        .when((F.size(words) == 2) & (dashes >= 1), first)
    )
    return F.coalesce(F.when(_date_t_time(ts), F.substring_index(ts, "T", 1)).otherwise(bare), F.lit("unknown"))


def event_time(ts: Column) -> Column:
    """Timestamp text -> TIMESTAMP_NTZ where it carries a full date, else NULL."""
    iso = F.regexp_extract(ts, r"^(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.replace(iso, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")


def event_hour(ts: Column) -> Column:
    """Hour of :func:`event_time`."""
    return F.date_trunc("hour", event_time(ts)).cast("timestamp_ntz")


def event_instant(ts: Column, zone: Column | None = None, default_minutes: int = 0, year: int | None = None) -> Column:
    """Timestamp text -> TIMESTAMP_NTZ in UTC, so that logs of different zones interleave rightly; NULL without a full date.

    The zone is what follows the time in the text, else ``zone`` (``+0530``,
    ``-08:00``, ``+01``, ``Z``, ``UTC`` or ``GMT``), else ``default_minutes`` east of
    Greenwich; a zone name that is none of these counts as not given. Fractions of a
    second stay. BSD times (``Jul 18 14:30:00``) have no year: ``year`` gives one.
    """
    text = F.trim(ts)
    iso = F.regexp_extract(text, r"^(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1)
    local = F.replace(iso, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz")
    if year is not None:
        words = _words(text)
        bsd = F.concat(F.lit(f"{year:04d}-"), _month(F.get(words, F.lit(0))), F.lit("-"),
                       _two_digits(F.get(words, F.lit(1)).try_cast("int")), F.lit(" "), F.get(words, F.lit(2)))
        local = F.when(text.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), bsd.try_cast("timestamp_ntz")).otherwise(local)
    tail = F.regexp_extract(text, r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)$", 1)
    named = F.nullif(tail, F.lit(""))
    if zone is not None:
        named = F.coalesce(named, F.trim(zone))
    minutes = F.coalesce(_zone_minutes(named), F.lit(default_minutes))
    return F.expr("INTERVAL '1' MINUTE") * (-minutes) + local


def _zone_minutes(zone: Column) -> Column:
    """Minutes east of Greenwich; NULL for a text that is no offset."""
    digits = F.regexp_replace(zone, "[+:-]", "")
    hours = F.left(digits, F.lit(2)).try_cast("int")
    rest = F.coalesce(F.substr(digits, F.lit(3)).try_cast("int"), F.lit(0))
    size = hours * 60 + rest
    return (
        F.when(F.upper(zone).isin("Z", "UTC", "GMT"), F.lit(0))
        .when(zone.rlike(r"^[+-]\d{2}(?::?\d{2})?$"), F.when(zone.startswith("-"), -size).otherwise(size))
    )
