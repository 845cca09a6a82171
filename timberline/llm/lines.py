"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of ascending id. The state is a set of runs: tables of
(line hash, first holder), bucketed and sorted by the hash. A batch folds its lines to
one row per hash, merge-anti-joins the runs (no run is shuffled or sorted again), and
what is left, the lines nobody had before, becomes a run of level 0. When a level holds
`fanout` runs they are merged into one run of the next level.

Decisions are joined on (hash, document), so a line held by every document is spread
over all tasks; a hash is folded before it is shuffled.

Defined results: null text is one empty line; rows with the same id are one document; a null id ranks after every other
id; keys of fewer than `min_chars` code points are never dropped; an empty table gives an empty result; columns other
than the id, the text and those named in `carry` are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import common

HASH = ["h1", "h2"]
_LAST_ID = 2**63 - 1


@dataclass
class Runs:
    """The levels of sorted runs, as names of bucketed tables in the shared folder."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(self.buckets(), *HASH).sortBy(*HASH)
         .option("path", common.scratch_path(self.spark, "run")).saveAsTable(name))
        return name

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose hash is in no run."""
        for name in self.tables():
            rows = rows.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        return rows

    def add(self, name: str, compact: bool = True) -> None:
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        level = 0
        while compact and len(self.levels[level]) >= self.fanout:
            merged = None
            for run in self.levels[level]:
                part = self.spark.table(run)
                merged = part if merged is None else merged.unionByName(part)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged.repartition(self.buckets(), *HASH)))
            for run in self.levels[level]:
                self.spark.sql(f"DROP TABLE {run}")
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        for name in self.tables():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def signatures(docs: DataFrame, min_chars: int) -> DataFrame:
    """(rank_id, text_hash, pos, h1, h2): one row per line whose key is long enough to be compared."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.btrim(F.col("line"), F.lit(common.SPACES))
    return (
        docs.select(F.coalesce(F.col("doc_id"), F.lit(_LAST_ID)).cast("long").alias("rank_id"),
                    F.xxhash64(text).alias("text_hash"),
                    F.posexplode(F.split(common.ascii_lower(text), "\n", -1)).alias("pos", "line"))
        .select("rank_id", "text_hash", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
        .select("rank_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit("second"), "key").alias("h2")))


def _in_batches(docs: DataFrame, rows: DataFrame, batches: int) -> DataFrame:
    """`rows` with a batch number that ascends with the id. The borders only balance the batches, they don't decide."""
    at = [i / batches for i in range(1, batches)]
    found = docs.select(F.percentile_approx("doc_id", at, 1000).alias("at")).first()["at"] if at else []
    batch = F.lit(0)
    for border in sorted(set(found or [])):
        batch = batch + (F.col("rank_id") > F.lit(border)).cast("int")
    return rows.withColumn("batch", batch)


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(rank_id, text_hash, pos) of every line whose key an earlier document holds. Stored before it returns."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sigs = common.stored(_in_batches(docs, signatures(docs, min_chars), batches), "lines", ["batch"])
    runs, parts, once = Runs(spark, fanout), [], []
    try:
        for batch in range(batches):
            mine = sigs.where(F.col("batch") == batch).drop("batch")
            first = mine.groupBy(*HASH).agg(F.min("rank_id").alias("owner"))
            name = runs.write(runs.unseen(first))
            once.append(name)
            owned = spark.table(name).withColumnRenamed("owner", "rank_id")
            parts.append(common.stored(mine.join(owned, [*HASH, "rank_id"], "left_anti").select(
                "rank_id", "text_hash", "pos"), "dropped"))
            runs.add(name, compact=batch + 1 < batches)
    finally:
        runs.close()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def line_dedup(docs: DataFrame, carry: tuple[str, ...] = (), min_chars: int = 10, batches: int = 4,
               fanout: int = 2) -> DataFrame:
    """One row per input row: doc_id, the columns of `carry`, kept_text, n_lines, n_dropped.

    The lines that go are listed by position, so the text itself is shuffled once, to meet
    its list; a list is never longer than the lines of its document.
    """
    gone = dropped_lines(docs, min_chars, batches, fanout).groupBy("rank_id", "text_hash").agg(
        F.collect_set("pos").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", *carry).select(
        "doc_id", *carry, text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(_LAST_ID)).cast("long").alias("rank_id"),
        F.xxhash64(text).alias("text_hash"))
    lines = rows.join(gone, ["rank_id", "text_hash"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.element_at("lines", i + 1)), "\n")
    return lines.select(
        "doc_id", *carry, F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
