"""Number expressions: exact rounding, safe conversion, exact sums, byte sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT_TEXT = r"^[+-]?[0-9]+$"
_FLOAT_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def round_exact(x: Column, digits: int) -> Column:
    """Round half-even on the exact binary value of a double.

    ``round`` and ``bround`` decide ties on the printed decimal (12.345 counts
    as a tie although the stored double lies above it). Here the product with
    the power of ten is computed together with its rounding error, so that
    only true ties are ties. Multiplying the halves by at most 10**3 is exact.
    """
    scale = float(10**digits)
    p = F.lit(scale)
    product = x * p
    high = x * F.lit(_SPLITTER) - (x * F.lit(_SPLITTER) - x)
    error = (high * p - product) + (x - high) * p
    nearest = F.rint(product)
    gap = product - nearest
    adjusted = (
        F.when((gap == 0.5) & (error > 0), nearest + 1.0)
        .when((gap == -0.5) & (error < 0), nearest - 1.0)
        .otherwise(nearest)
    )
    return F.when(F.abs(x) >= 1e12, x).otherwise(adjusted / p)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100`` rounded; 0 when there is nothing to divide by."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    return F.coalesce(round_exact(ratio, digits), F.lit(0.0))


def to_int(text: Column) -> Column:
    """Integer text -> BIGINT, anything else -> NULL (same in ANSI and legacy mode)."""
    t = F.trim(text)
    return F.when(t.rlike(_INT_TEXT), t.try_cast("bigint"))


def to_float(text: Column) -> Column:
    """Finite decimal text -> DOUBLE, anything else -> NULL.

    ``nan`` and ``inf`` texts are not measurements and give NULL.
    """
    t = F.trim(text)
    v = F.when(t.rlike(_FLOAT_TEXT), t.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def exact_total(value: Column, weight: Column | None = None) -> Column:
    """Aggregate: sum of doubles that does not depend on the order of the rows.

    Values below 1e10 are added as decimals with nine places, so a retried or
    re-partitioned stage gives the same sum and the same rounded mean. A group
    holding larger values falls back to the double sum.
    """
    w = F.lit(1) if weight is None else weight
    fixed = value.try_cast("decimal(19,9)")
    exact = F.sum(fixed * w.cast("decimal(18,0)"))
    plain = F.sum(value * w.cast("double"))
    return F.when(F.count(fixed) == F.count(value), exact.cast("double")).otherwise(plain)


def human_bytes(n: Column, digits: int = 2) -> Column:
    """1536 -> ``1.50 KB``; units of 1024 up to PB."""
    x = n.cast("double")
    # fixed values: unit names in order
    units = ["B", "KB", "MB", "GB", "TB"]
    fmt = f"%.{digits}f "
    out = None
    for power, unit in enumerate(units):
        scaled = x / float(1024**power)
        text = F.format_string(fmt + unit, round_exact(scaled, digits))
        cond = F.abs(scaled) < 1024.0
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.format_string(fmt + "PB", round_exact(x / float(1024**5), digits)))


def number_label(x: Column, digits: int = 2) -> Column:
    """Text of a rounded double the way a person writes it: ``1.5``, ``20.0``, ``12000000.0``."""
    fixed = F.format_string(f"%.{digits}f", round_exact(x, digits))
    # drop trailing zeros but keep one digit after the point
    return F.regexp_replace(fixed, r"(\.[0-9]+?)0+$", "$1")
