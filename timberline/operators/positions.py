"""Positions along a source without putting a whole source into one task.

A source is cut into blocks of consecutive line numbers. Work within a block
is a window over (source, block); what has to cross block borders is one row
per block, carried by a window over that small table and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.operators.once import all_of

BLOCK_LINES = 16_384


def _with_block(df: DataFrame, block_lines: int) -> DataFrame:
    """Rows placed by block. The block totals and the windows both read this one shuffle."""
    blocked = df.withColumn("_block", F.floor(F.col("line_no") / block_lines))
    placed = F.col("source").isNotNull() & F.col("_block").isNotNull()
    return blocked.where(placed).repartition("source", "_block")


def _readable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed; a map counts by its entries."""
    return [F.map_entries(n) if kind.startswith("map<") else F.col(n) for n, kind in df.dtypes]


def entry_index(entries: DataFrame, block_lines: int = BLOCK_LINES, with_total: bool = False) -> DataFrame:
    """Add ``entry_idx``: position from 0 among the given rows of each source.

    ``with_total`` also adds ``entry_total``, the number of rows of the source.
    """
    blocked = _with_block(entries, block_lines)
    counts = blocked.groupBy("source", "_block").agg(F.count_if(all_of(*_readable(blocked))).alias("_n"))
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "source", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(W.partitionBy("source")).alias("entry_total")] if with_total else []),
    )
    inside = W.partitionBy("source", "_block").orderBy("line_no")
    return (
        blocked.join(starts, ["source", "_block"])
        .withColumn("entry_idx", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_block", "_start")
    )


def last_before(lines: DataFrame, value: Column, name: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Add the latest non-NULL ``value`` of the lines before each line of its source."""
    blocked = _with_block(lines.withColumn("_v", value), block_lines)
    at = F.when(F.col("_v").isNotNull() & all_of(*_readable(blocked)), F.col("line_no"))
    ends = blocked.groupBy("source", "_block").agg(F.max_by("_v", at).alias("_end"))
    earlier = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("source", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy("source", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.join(carried, ["source", "_block"])
        .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_v", "_carried")
    )


def indexed_rows(entries: DataFrame, keep: Column, columns: dict[str, Column]) -> DataFrame:
    """Chosen columns of the rows where ``keep`` holds, with their ``entry_idx``.

    All rows take part in the numbering, but rows that are not kept travel
    without their columns.
    """
    payload = F.struct(*[c.alias(n) for n, c in columns.items()])
    slim = entries.select("source", "line_no", F.when(keep, payload).alias("_p"))
    return entry_index(slim).where(F.col("_p").isNotNull()).select("source", "line_no", "_p.*", "entry_idx")
