"""Frequency tables, totals and nested counts.

``by`` is () for one report over all rows, or ("source",) for one per source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.numeric import percent
from timberline.operators.once import all_of


def _order(by: Sequence[str]) -> list[Column]:
    return [F.col(b).asc() for b in by] + [F.col("_n").desc(), F.col("_first").asc()]


def _counted(df: DataFrame, keys: Mapping[str, Column], by: Sequence[str],
             detected: Column | None = None) -> DataFrame:
    """Rows, first line and number of labelled rows per key."""
    cols = [F.col(b) for b in by] + [c.alias(n) for n, c in keys.items()]
    present = list(keys.values())[-1].isNotNull() if detected is None else detected
    return df.select(*cols, present.alias("_present"), "line_no").groupBy(*by, *keys).agg(
        F.count("*").alias("_n"), F.min("line_no").alias("_first"),
        F.count_if("_present").alias("_labelled"),
    )


def frequencies(
    df: DataFrame, label: Column, by: Sequence[str] = (), label_name: str = "label",
    count_name: str = "value", limit: int | None = None,
) -> DataFrame:
    """Rows per label, most frequent first, ties by first appearance.

    Counting combines on the map side, so a hot label costs one row per task.
    ``limit`` is the top-k form, per report: over all rows it plans as
    TakeOrderedAndProject, with ``by`` as a rank that each task cuts off before
    the shuffle (WindowGroupLimit).
    """
    counts = _counted(df, {label_name: label}, by).where(F.col("_labelled") > 0)
    if limit is not None and by:
        place = F.row_number().over(W.partitionBy(*by).orderBy(*_order(())))
        counts = counts.withColumn("_place", place).where(F.col("_place") <= limit)
    counts = counts.orderBy(*_order(by))
    if limit is not None and not by:
        counts = counts.limit(limit)
    return counts.select(*by, label_name, F.col("_n").alias(count_name))


def shares(
    df: DataFrame, label: Column, by: Sequence[str] = (), label_name: str = "label",
    of_labelled: bool = False, extra: Mapping[str, Column] | None = None, detected: Column | None = None,
) -> DataFrame:
    """:func:`frequencies` with ``pct`` of all rows (or of the labelled rows).

    The total is the sum of the group counts, so both branches read one and
    the same shuffle and the lines are parsed once. Without ``by`` the total
    is a single row and is broadcast.

    ``detected`` marks rows that have the column at all; with it NULL is a
    label like any other, and a report without such rows has no table.
    """
    counts = _counted(df, {label_name: label}, by, detected)
    rows = F.col("_labelled") if of_labelled else F.col("_n")
    totals = counts.groupBy(*by).agg(
        F.sum(F.when(all_of(*counts.columns), rows)).alias("_total"), F.sum("_labelled").alias("_seen"))
    joined = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))
    shown = F.col("_labelled" if detected is None else "_seen") > 0
    joined = joined.where(shown & all_of(*counts.columns))
    out = joined.orderBy(*_order(by)).select(
        *by, label_name, F.col("_n").alias("count"), percent(F.col("_n"), F.col("_total")).alias("pct"),
    )
    for name, column in (extra or {}).items():
        out = out.withColumn(name, column)
    return out


def dimension_counts(df: DataFrame, dims: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Many frequency tables in one pass and one shuffle: ``(dim, label, value)``."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("dim"), c.cast("string").alias("label")) for n, c in dims.items()
    ])
    long = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.dim", "p.label")
    return long.where(F.col("label").isNotNull()).groupBy(*by, "dim", "label").agg(F.count("*").alias("value"))


def timeline(df: DataFrame, label: Column, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Rows per hour or day label, in label order."""
    rows = df if where is None else df.where(where)
    return (
        rows.select(*by, label.alias("label")).groupBy(*by, "label").agg(F.count("*").alias("value"))
        .orderBy(*by, "label")
    )


def pair_counts(
    df: DataFrame, key: Column, sub: Column, key_name: str, sub_name: str, by: Sequence[str] = (),
) -> DataFrame:
    """Nested counts in long form: one row per (key, sub-key).

    This is the whole result whatever the number of sub-keys; nothing is
    collected per key.
    """
    return (
        df.select(*by, key.alias(key_name), sub.alias(sub_name))
        .where(F.col(key_name).isNotNull() & F.col(sub_name).isNotNull())
        .groupBy(*by, key_name, sub_name).agg(F.count("*").alias("count"))
    )


def status_lists(df: DataFrame, key: Column, status: Column, key_name: str, by: Sequence[str] = ()) -> DataFrame:
    """Nested counts as one list per key, for sub-keys of bounded number.

    ``status`` is a three-digit code, so a list holds at most 1000 structs;
    most frequent first, ties by first appearance.
    """
    counts = _counted(df, {key_name: key, "status": status}, by).where(F.col("status").isNotNull())
    entry = F.struct((-F.col("_n")).alias("neg"), F.col("_first").alias("first"), F.col("status").alias("status"))
    lists = counts.groupBy(*by, key_name).agg(F.sort_array(F.collect_list(entry)).alias("_l"))
    return lists.select(*by, key_name, F.transform("_l", lambda x: F.struct(
        x["status"].alias("status"), (-x["neg"]).alias("count"))).alias("status_codes"))
