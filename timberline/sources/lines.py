"""Lines of text with their source and line number.

Every operator takes a ``lines`` DataFrame ``(source STRING, line_no BIGINT,
value STRING)``; ``line_no`` counts from 0 within a source, blank lines included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

LINES_SCHEMA = "source string, line_no bigint, value string"

# A split table row is a path, two longs and a count; this many stay well under 100 MB.
_MAX_BROADCAST_SPLITS = 200_000

# A line takes up to a fifth of a millisecond to parse, so a task of this many takes less than a minute.
_MOST_ROWS = 200_000


def _split(text: str) -> list[str]:
    """Lines as in a file of that text: they end at CR, LF or both, and blank ones count."""
    lines = re.split("\r\n|\n|\r", text)
    return lines[:-1] if lines[-1] == "" else lines


def lines_from_text(spark: SparkSession, text: str, source: str = "pasted") -> DataFrame:
    """Lines of one pasted text, numbered as in a file."""
    rows = [(source, i, line) for i, line in enumerate(_split(text))]
    return spark.createDataFrame(rows, LINES_SCHEMA)


def lines_from_files(spark: SparkSession, files: Iterable[tuple[str, str]]) -> DataFrame:
    """Lines of several pasted texts, given as ``(name, content)``.

    A name that came before gets a number, ``a.log (2)``: each text is a source of its own.
    """
    seen: dict[str, int] = {}
    rows = []
    for name, content in files:
        seen[name] = seen.get(name, 0) + 1
        source = name if seen[name] == 1 else f"{name} ({seen[name]})"
        rows += [(source, i, line) for i, line in enumerate(_split(content))]
    return spark.createDataFrame(rows, LINES_SCHEMA)


def read_lines(spark: SparkSession, paths: str | Sequence[str], full_path: bool = True) -> DataFrame:
    """Text files as numbered lines. Undecodable bytes read as U+FFFD.

    The source is the whole path. ``full_path=False`` gives the last part of the
    path instead, and raises ValueError where two files share it: (source,
    line_no) has to name one line.

    Numbering needs no shuffle of the text. Rows of one split arrive in file
    order, so ``monotonically_increasing_id`` is consecutive within a split. A
    first pass that reads no text column counts the lines of each split and
    notes its first id; a running sum over the splits of a file gives the line
    number of each split's first line, and the second pass adds the distance
    from the first id.

    The split table is broadcast while the number of files and read partitions
    shows it to be small; beyond that it is joined on (file, split).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    located = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.make_valid_utf8("value").alias("value"),
    )
    splits = located.groupBy("path", "split_start").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id")
    )
    before = W.partitionBy("path").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "path", "split_start",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id")).alias("shift"),
    )
    split_bound = raw.rdd.getNumPartitions() + len(raw.inputFiles())
    if split_bound <= _MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    if not full_path:
        files = raw.inputFiles()
        if len({f.rpartition("/")[2] for f in files}) < len(files):
            raise ValueError("Several files have one name: read them with full_path=True")
    name = F.col("path") if full_path else F.element_at(F.split("path", "/"), -1)
    return located.join(offsets, ["path", "split_start"]).select(
        name.alias("source"), (F.col("row_id") + F.col("shift")).alias("line_no"), "value"
    )


def lines_of(df: DataFrame, value: str, line_no: str, source: str | None = None, name: str = "table") -> DataFrame:
    """Any table of texts as lines.

    ``line_no`` counts from 0 without gaps within a source: detection looks at the
    lines below 50, and line 0 is the header of a CSV source.
    """
    src = F.col(source).cast("string") if source else F.lit(name)
    return df.select(
        src.alias("source"), F.col(line_no).cast("bigint").alias("line_no"), F.col(value).alias("value")
    )


def _hashable(column: DataType) -> bool:
    """Whether rows can be dealt out by the hash of such a column: maps and variants have none."""
    if isinstance(column, StructType):
        return all(_hashable(f.dataType) for f in column.fields)
    if isinstance(column, ArrayType):
        return _hashable(column.elementType)
    return not isinstance(column, MapType | VariantType)


def spread(df: DataFrame, most: int = _MOST_ROWS) -> DataFrame:
    """Deal rows out to all cores, and to as many partitions that none holds many more than ``most`` rows.

    Parsing is CPU work per line; an input of few large splits (a gzip file, a
    single row group) would leave cores idle, and a partition count that does
    not follow the rows makes tasks, and what they sort or hash, grow with the
    input. A job counts the rows of each partition (a table file tells them in
    its footers). Inputs dealt well enough are returned as they are, without a
    shuffle; others go by the hash of the row, which needs no sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("p")).count().agg(
        F.sum("count").alias("rows"), F.max("count").alias("largest")).first()
    if df.rdd.getNumPartitions() >= cores and (held["largest"] or 0) <= most:
        return df
    parts = max(cores, math.ceil((held["rows"] or 0) / most))
    keys = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    return df.repartition(parts, *keys)
