"""Raw lines around entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context(lines: DataFrame, picked: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Lines ``[line_no - before, line_no + after]`` of every picked entry.

    ``picked`` has ``(source, line_no, entry_idx)``. The range is unrolled into
    single line numbers, so this is an equi-join on (source, line_no) for any
    number of entries, and each needed line is fetched by its key.
    """
    span = F.sequence(F.greatest(F.lit(0), F.col("line_no") - before), F.col("line_no") + after)
    wanted = picked.select(
        "source", "entry_idx", F.col("line_no").alias("center_line"), F.explode(span).alias("line_num"))
    raw = lines.select("source", F.col("line_no").alias("line_num"), F.col("value").alias("content"))
    return wanted.join(raw, ["source", "line_num"]).select(
        "source", "entry_idx", "center_line", "line_num", "content",
        (F.col("line_num") == F.col("center_line")).alias("is_match"))


def context_of_entry(lines: DataFrame, indexed: DataFrame, source: str, entry_idx: int,
                     before: int = 3, after: int = 3) -> DataFrame:
    """Context of one entry; raises ValueError when the source has no such entry."""
    picked = indexed.where((F.col("source") == source) & (F.col("entry_idx") == entry_idx)).select(
        "source", "line_no", "entry_idx").take(1)
    if not picked:
        raise ValueError("invalid entry index")
    center = picked[0]["line_no"]
    near = lines.where((F.col("source") == source) & F.col("line_no").between(max(0, center - before), center + after))
    return near.select(
        "source", F.lit(entry_idx).cast("bigint").alias("entry_idx"), F.lit(center).cast("bigint").alias("center_line"),
        F.col("line_no").alias("line_num"), F.col("value").alias("content"),
        (F.col("line_no") == center).alias("is_match")).orderBy("line_num")
