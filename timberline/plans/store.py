"""A store of logs: each file's text is read once, everything else comes from tables.

``add`` takes files that the store does not have in this length and age, and
writes, under a batch of its own:

- ``lines``: the raw lines, in the order of the scan. The one read of the text.
- ``splits``: one row per split of a file: the table file that holds it, its
  first line number and its size. It numbers lines, tells which table files a
  log type or a line range needs, and is the index for context.
- ``files``: one row per file: type, confidence, scores, place in the order of
  sources, and an error for files without a report.
- ``entries/<type>``: typed rows, parsed from ``lines`` of this type's files only,
  by day.
- ``hours`` and ``distinct``: value counts of response times and sketches of clients and paths per source, day
  and hour, which add up over batches (see :mod:`timberline.plans.hours`).

A batch counts from the moment its row stands in ``batches``, which is written
last: what a failed or repeated job left behind is never read. A file that
comes again with another length or age replaces its former rows. Reports read
only the columns they need of typed rows; nothing is parsed again.

Settings that depend on the reader (thresholds, excluded clients) are
applied when a report is made, never stored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.clock import event_time
from timberline.operators.detect import SAMPLE_LINES
from timberline.operators.entries import bookkeeping
from timberline.operators.parse_csv import parse_csv
from timberline.plans import analyze as an
from timberline.plans import hours
from timberline.plans.options import Options
from timberline.sources.lines import LINES_SCHEMA

_MAX_BROADCAST_SPLITS = 200_000
def _schema(*fields: tuple[str, str]) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
             "scores": T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("score", T.LongType())]))}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


_FILES = _schema(("source", "string"), ("path", "string"), ("length", "bigint"), ("modified", "timestamp"), ("log_type", "string"),
                 ("confidence", "double"), ("scores", "scores"), ("error", "string"), ("place", "bigint"))
_SPLITS = _schema(("source", "string"), ("split_start", "bigint"), ("part", "string"), ("first_id", "bigint"), ("first_line", "bigint"),
                  ("n", "bigint"))
_LINES = _schema(("source", "string"), ("split_start", "bigint"), ("row_id", "bigint"), ("value", "string"))
_BATCHES = _schema(("number", "bigint"), ("batch", "string"), ("replaces", "boolean"))


def _and(schema: T.StructType, column: str) -> T.StructType:
    """The schema with one more text column, the one that partitions the table."""
    return T.StructType([*schema.fields, T.StructField(column, T.StringType())])


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(source, path, length, modified)`` of the files, contents not read; ``source`` is the name that reading gives.

    Scans pass over files without a byte; they are taken from the list of
    files that Spark itself holds, with length 0 and no time.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("source"), "path", "length", F.col("modificationTime").alias("modified"))
    every = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in spark.read.text(paths).inputFiles()]
    empty = spark.createDataFrame(every, "path string").join(listed.select("path"), "path", "left_anti")
    return listed.unionByName(empty.select(
        F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")).alias("source"), "path",
        F.lit(0).cast("bigint").alias("length"), F.timestamp_seconds(F.lit(0)).alias("modified")))


class LogStore:
    """The store at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # tables

    def _batches(self) -> list[tuple[int, str, bool]]:
        """(number, id, whether it replaces files of earlier ones) of the finished batches: one small row per ``add``."""
        table = self._saved("batches", _BATCHES)
        return [] if table is None else sorted(map(tuple, table.select("number", "batch", "replaces").collect()))

    def _saved(self, name: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows of the finished batches, without those of files that a later batch has again."""
        done = self._batches()
        table = self._saved(name, _and(schema, "batch"))
        if table is None or not done:
            return self.spark.createDataFrame([], schema)
        table = table.where(F.col("batch").isin(*[b for _, b, _ in done]))
        if any(replaces for *_, replaces in done):
            table = table.join(self._replaced(done), ["source", "batch"], "left_anti")
        return table.drop("batch")

    def _replaced(self, done: list[tuple[int, str, bool]]) -> DataFrame:
        """(source, batch) of rows that no longer count; a file's latest batch does."""
        number = F.create_map(*[F.lit(x) for n, b, _ in done for x in (b, n)])
        held = self._saved("files", _and(_FILES, "batch")).where(F.col("batch").isin(*[b for _, b, _ in done]))
        held = held.select("source", "batch", F.element_at(number, F.col("batch")).alias("n"))
        last = F.max("n").over(W.partitionBy("source"))
        return held.withColumn("last", last).where("n < last").select("source", "batch")

    def files(self) -> DataFrame:
        """One row per file."""
        return self._table("files", _FILES)

    def lines(self, sources: DataFrame | None = None) -> DataFrame:
        """Numbered lines of all or the given sources, from the table files that hold them."""
        splits = self._table("splits", _SPLITS)
        if sources is not None:
            splits = splits.join(sources.select("source"), "source", "left_semi")
        return self._numbered(splits)

    def _numbered(self, splits: DataFrame) -> DataFrame:
        """Lines of the given splits. The names of table files reach the driver, as those of any scan do."""
        parts = [r["part"] for r in splits.select("part").distinct().collect()]
        if not parts:
            return self.spark.createDataFrame([], LINES_SCHEMA)
        return self._located(parts, splits).select(
            "source", (F.col("row_id") - F.col("first_id") + F.col("first_line")).alias("line_no"), "value")

    def _rows(self, parts: Iterable[str]) -> DataFrame:
        """Rows of table files, with the file's name as ``part``."""
        return self.spark.read.schema(_LINES).parquet(*sorted(map(unquote, parts))).withColumn("part", F.col("_metadata.file_path"))

    def _located(self, parts: Iterable[str], splits: DataFrame) -> DataFrame:
        wanted = splits.select("part", "source", "split_start", "first_id", "first_line")
        if splits.count() <= _MAX_BROADCAST_SPLITS:
            wanted = F.broadcast(wanted)
        return self._rows(parts).join(wanted, ["part", "source", "split_start"])

    def table(self, log_type: str, options: Options = Options(), days: Sequence[str] | None = None) -> DataFrame:
        """Typed rows of a log type; ``days`` (``2025-07-18``) reads only these, by the day that stands in the timestamp."""
        out = self._table(f"entries/{log_type}", _and(an.typed_schema(self.spark, log_type), "day"))
        if days is not None:
            out = out.where(F.col("day").isin(*days))
        if log_type == "postgres":
            out = out.withColumn("slow", F.coalesce(F.col("duration_ms") >= options.slow * 1000.0, F.lit(False)))
        return out.drop("day")

    def types(self) -> list[str]:
        """Log types that the store holds, in the fixed order."""
        found = {r["log_type"] for r in self.files().select("log_type").distinct().collect()}
        return [t for t in an.PARSERS if t in found]

    # adding

    def add(self, paths: str | Sequence[str], log_type: str = "auto") -> DataFrame:
        """Take in the files that are new or have changed; returns their rows of ``files``.

        Files are told apart by path, length and time of change. Their order
        as sources is that of the batches, then of their paths.
        """
        listed = list_files(self.spark, paths)
        new = listed.join(self.files().select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
        names = sorted(r["path"] for r in new.select("path").distinct().collect())
        if not names:
            return self.spark.createDataFrame([], _FILES)
        number, batch = len(self._batches()), uuid.uuid4().hex
        self._write_lines(names, batch)
        self._write_splits(batch)
        files = self._write_files(new, batch, number, log_type)
        for t in [t for t in an.PARSERS if not files.where(F.col("log_type") == t).isEmpty()]:
            self._write_entries(files.where(F.col("log_type") == t), t, batch)
        earlier = self.files().select("source")
        replaces = not files.join(earlier, "source", "left_semi").isEmpty()
        self.spark.createDataFrame([(number, batch, replaces)], _BATCHES).coalesce(
            1).write.mode("append").parquet(f"{self.path}/batches")
        return files

    def _write_lines(self, names: list[str], batch: str) -> None:
        raw = self.spark.read.text(names).select(
            F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_id"), F.make_valid_utf8("value").alias("value"))
        raw.write.parquet(f"{self.path}/lines/batch={batch}")

    def _write_splits(self, batch: str) -> None:
        """Rows of one split have consecutive ids, in file order."""
        lines = self.spark.read.schema(_LINES).parquet(f"{self.path}/lines/batch={batch}")
        held = lines.groupBy("source", "split_start", F.col("_metadata.file_path").alias("part")).agg(
            F.min("row_id").alias("first_id"), F.count("*").alias("n"))
        before = W.partitionBy("source").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
        held.select("source", "split_start", "part", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_line"), "n").write.parquet(
            f"{self.path}/splits/batch={batch}")

    def _batch_splits(self, batch: str) -> DataFrame:
        return self.spark.read.schema(_SPLITS).parquet(f"{self.path}/splits/batch={batch}")

    def _write_files(self, new: DataFrame, batch: str, number: int, log_type: str) -> DataFrame:
        heads = self._numbered(self._batch_splits(batch).where(F.col("first_line") < SAMPLE_LINES)).where(F.col("line_no") < SAMPLE_LINES)
        kinds = an.typed_sources(heads, log_type, with_scores=True)
        empty = F.concat(F.col("source"), F.lit(" holds no lines to read"))
        placed = F.row_number().over(W.orderBy("path")) - 1 + F.lit(number) * F.lit(1 << 40)
        files = new.join(kinds, "source", "left").select(
            "source", "path", "length", "modified", "log_type", "confidence", "scores",
            F.when(F.col("filled").isNull(), empty).otherwise(F.col("error")).alias("error"), placed.cast("bigint").alias("place"))
        files.write.parquet(f"{self.path}/files/batch={batch}")
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files/batch={batch}")

    def _write_entries(self, files: DataFrame, log_type: str, batch: str) -> None:
        splits = self._batch_splits(batch).join(files.select("source"), "source", "left_semi")
        lines = self._numbered(splits)
        if log_type == "csv":
            typed = parse_csv(lines, self._numbered(splits.where("first_line = 0")).where("line_no = 0"))
        else:
            typed = an.parse(lines, log_type)
        day = F.coalesce(F.to_date(event_time(F.col("timestamp"))).cast("string"), F.lit("none"))
        typed.withColumn("day", day).write.partitionBy("day").parquet(f"{self.path}/entries/{log_type}/batch={batch}")
        if log_type == "nginx_access":
            stored = self.spark.read.schema(_and(an.typed_schema(self.spark, log_type), "day")).parquet(
                f"{self.path}/entries/{log_type}/batch={batch}")
            hours.hourly_states(stored).write.partitionBy("day").parquet(f"{self.path}/hours/batch={batch}")
            hours.distinct_states(stored).write.partitionBy("day").parquet(f"{self.path}/distinct/batch={batch}")

    # what comes out

    def report(self, log_type: str, options: Options = Options(), days: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """All outputs for the files of a type together."""
        return an.report(self.table(log_type, options, days), log_type, options)

    def batch(self, options: Options = Options()) -> dict[str, dict[str, DataFrame]]:
        """One report per source and type, as :func:`timberline.plans.analyze.batch`."""
        per_source = Options(options.slow, options.critical, ("source",), options.exclude)
        return {"sources": {"sources": self.sources()}} | {t: self.report(t, per_source) for t in self.types()}

    def sources(self) -> DataFrame:
        """``(source, log_type, confidence, error)`` in the order of the files."""
        return self.files().orderBy("place").select("source", "log_type", "confidence", "error")

    def overview(self, options: Options = Options()) -> DataFrame:
        """One row per source: type, confidence, error, line totals and time range."""
        totals = None
        for t in self.types():
            part = bookkeeping(self.table(t, options), ("source",), options.exclude)
            totals = part if totals is None else totals.unionByName(part)
        files = self.files().select("source", "log_type", "confidence", "error", "place")
        out = files if totals is None else files.join(totals, "source", "left")
        return out.orderBy("place").drop("place")

    def hours(self, days: Sequence[str] | None = None) -> DataFrame:
        """Hourly states of the access logs, to be read by :mod:`timberline.plans.hours`."""
        out = self._table("hours", hours.SCHEMA)
        return out if days is None else out.where(F.col("day").isin(*days))

    def distinct(self, days: Sequence[str] | None = None) -> DataFrame:
        """Hourly sketches of clients and paths, for :func:`timberline.plans.hours.distinct_estimates`."""
        out = self._table("distinct", hours.DISTINCT_SCHEMA)
        return out if days is None else out.where(F.col("day").isin(*days))

    def timeline(self, options: Options = Options(), by_time: bool = False, year: int | None = None) -> DataFrame:
        """Entries of all files in one timeline, files of equal times in their order (see :func:`timberline.plans.analyze.correlate`)."""
        places = self.files().select("source", "place")
        return an.in_order(an.union([an.timeline_rows(self.table(t, options), t, options.exclude, by_time, year) for t in self.types()]), places, by_time)

    def context(self, picked: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
        """Raw lines around entries ``(source, line_no, entry_idx)``, from the splits that hold them only."""
        low, high = F.greatest(F.lit(0), F.col("line_no") - before), F.col("line_no") + after
        wanted = picked.select("source", "entry_idx", F.col("line_no").alias("center_line"), low.alias("low"), high.alias("high"))
        splits = self._table("splits", _SPLITS)
        near = splits.join(wanted, "source").where("low < first_line + n and high >= first_line")
        needed = near.select(*splits.columns).distinct()
        parts = [r["part"] for r in needed.select("part").distinct().collect()]
        if not parts:
            return self._numbered(needed).select("source", F.lit(0).cast("bigint").alias("entry_idx"), F.col("line_no").alias("center_line"),
                                                 F.col("line_no").alias("line_num"), F.col("value").alias("content"), F.lit(False).alias("is_match"))
        # each line of a split is fetched by its id
        ids = near.select("part", "source", "split_start", "entry_idx", "center_line", "first_line", "first_id", F.explode(F.sequence(
            F.greatest("low", "first_line"), F.least("high", F.col("first_line") + F.col("n") - 1))).alias("line_num")).withColumn(
            "row_id", F.col("line_num") - F.col("first_line") + F.col("first_id"))
        return ids.join(self._rows(parts), ["part", "source", "split_start", "row_id"]).select(
            "source", "entry_idx", "center_line", "line_num", F.col("value").alias("content"),
            (F.col("line_num") == F.col("center_line")).alias("is_match"))
