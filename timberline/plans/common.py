"""Pieces shared by the reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import shorten
from timberline.operators import frequency as fq
from timberline.operators.entries import entries
from timberline.plans.options import Options, Output


def frequency_chart(label: Callable[[], Column]) -> Output:
    """Chart output ``(label, value)`` of one column."""
    def output(df: DataFrame, o: Options) -> DataFrame:
        return fq.frequencies(entries(df, o.exclude), label(), o.by)
    return output


def message_chart(text: Callable[[], Column], limit: int | None = None) -> Output:
    """Chart output of message forms: counted on the whole form, labelled with its first 80 characters."""
    def output(df: DataFrame, o: Options) -> DataFrame:
        counts = fq.frequencies(entries(df, o.exclude), text(), o.by, "form", "value", limit=limit)
        return counts.select(*o.by, shorten(F.col("form")).alias("label"), "value")
    return output


def share_table(label: Callable[[], Column], name: str, **options) -> Output:
    """Table output ``(name, count, pct)`` of one column."""
    def output(df: DataFrame, o: Options) -> DataFrame:
        return fq.shares(entries(df, o.exclude), label(), o.by, name, **options)
    return output


def hourly(label: Callable[[], Column], where: Callable[[], Column] | None = None) -> Output:
    """Timeline output ``(label, value)`` in label order."""
    def output(df: DataFrame, o: Options) -> DataFrame:
        return fq.timeline(entries(df, o.exclude), label(), o.by, where() if where else None)
    return output


def join_reports(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One-row-per-report frames side by side; without ``by`` each is exactly one row."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(by), "left") if by else out.crossJoin(F.broadcast(part))
    return out
