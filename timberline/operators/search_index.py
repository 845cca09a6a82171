"""An index for searching stored rows: which blocks of rows hold which three letters.

Rows lie in blocks, numbered upwards in each file. One shuffle builds the
posting table (three letters, block), each pair once. A search takes the blocks that hold
all three-letter parts of its text, reads these, and looks at their rows as
:func:`timberline.operators.search.search` does, so it gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.search import row_text, search

_GRAM = 3
# up to this many blocks are named in a filter that reaches the scan; more are joined
_NAMED_BLOCKS = 1_000


def _grams(text: Column) -> Column:
    """The distinct parts of three letters."""
    places = F.sequence(F.lit(1), F.length(text) - (_GRAM - 1))
    return F.when(F.length(text) >= _GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(_GRAM)))))


def build(df: DataFrame, path: str, rows_per_block: int = 4_096) -> None:
    """Write the rows and their index to ``path``, a folder that driver and executors share."""
    at = F.monotonically_increasing_id()
    task, place = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    df.withColumn("_block", F.shiftleft(task, 32) + F.floor(place / rows_per_block).cast("bigint")).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    text = F.lower(row_text(rows.drop("_block")))
    rows.select("_block", F.explode(_grams(text)).alias("gram")).distinct().repartition("gram").sortWithinPartitions(
        "gram", "_block").write.parquet(f"{path}/grams")


def blocks_of(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """``(_block)`` of the blocks that may hold the text; None if it is too short to tell."""
    low = text.lower()
    wanted = sorted({low[i:i + _GRAM] for i in range(len(low) - _GRAM + 1)})
    if not wanted:
        return None
    held = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*wanted))
    return held.groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("_block")


def search_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The rows with the text in any column, case ignored."""
    rows = spark.read.parquet(f"{path}/rows")
    blocks = blocks_of(spark, path, text)
    if blocks is not None:
        named = [r["_block"] for r in blocks.limit(_NAMED_BLOCKS + 1).collect()]
        rows = rows.where(F.col("_block").isin(*named)) if len(named) <= _NAMED_BLOCKS else rows.join(blocks, "_block", "left_semi")
    return search(rows.drop("_block"), text)
