"""Exact distribution statistics that scale with the data.

Values are first folded to ``(group, value, count)``, which combines on the
map side. Order statistics then come in two steps: values are cut into
coarse, order-preserving buckets; a running sum over the few buckets of a
group says in which bucket a wanted rank lies; only the values of these
buckets are ordered, one task per (group, bucket). No task ever holds all
values of a group, however hot the group.

The percentile of n values at p is element ``min(floor(n * p), n - 1)`` of the
sorted list, with no interpolation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.numeric import round_exact
from timberline.operators.once import all_of

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
_STEPS_PER_OCTAVE = 64.0


def bucket(v: Column) -> Column:
    """Order-preserving coarse bucket: logarithmic, 64 per doubling, signed; never NULL."""
    size = (F.floor(F.log2(F.abs(v)) * _STEPS_PER_OCTAVE) + F.lit(100_000)).cast("int")
    return F.coalesce(F.when(v > 0, size).when(v < 0, -size), F.lit(0))


def value_counts(df: DataFrame, keys: Sequence[str], value: Column,
                 measures: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Rows per (keys, value), with further mergeable measures; NULL values keep their own row.

    Rows with a NULL key are left out. The filter and the bucket column are
    part of this step so that every later branch starts from one identical
    shuffle, which Spark then runs once.
    """
    measures = measures or {}
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    inputs = [c.alias(f"_in_{n}") for n, (_, c) in measures.items()]
    long = df.select(*keys, value.cast("double").alias("_v"), *inputs)
    aggs = [_FOLD[kind](F.col(f"_in_{n}")).alias(n) for n, (kind, _) in measures.items()]
    return long.withColumn("_b", bucket(F.col("_v"))).groupBy(*keys, "_b", "_v").agg(
        F.count("*").alias("_c"), F.count("_v").alias("_valued"), *aggs)


def _exact_sum(column: Column | str) -> Column:
    """Sum of whole numbers, in decimals: log text may hold any 64-bit number, and sums of those overflow."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)"))


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "total": _exact_sum}
# a total beyond 64 bits shows as the largest 64-bit number
_MOST = 2**63 - 1


def _shown(name: str, kind: str) -> Column:
    return F.least(F.col(name), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint").alias(name) if kind == "total" else F.col(name)


def _ranked_buckets(counts: DataFrame, keys: Sequence[str],
                    measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One row per (keys, bucket): size, partial statistics, rows in lower buckets, rows in the group."""
    value, weight = F.col("_v"), F.col("_c")
    has = value.isNotNull()
    per_bucket = counts.groupBy(*keys, "_b").agg(
        F.sum(F.when(has & all_of(*counts.columns), weight).otherwise(0)).alias("_n"),
        F.sum(weight).alias("_rows"),
        F.sum((value.try_cast("decimal(19,9)") * weight.cast("decimal(18,0)"))).alias("_exact"),
        (F.count(value) - F.count(value.try_cast("decimal(19,9)"))).alias("_inexact"),
        F.sum(value * weight.cast("double")).alias("_plain"),
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        *[_FOLD[kind](n).alias(n) for n, (kind, _) in measures.items()],
    )
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    running = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_bucket.select(
        "*",
        (F.sum("_n").over(running) - F.col("_n")).alias("_base"),
        F.sum("_n").over(whole).alias("_total"),
    )


def pick_ranks(counts: DataFrame, buckets: DataFrame, keys: Sequence[str], targets: Column) -> DataFrame:
    """Values at wanted ranks: ``(keys, _total, name, rank, value)``.

    ``targets`` is an array of ``(name, rank)`` computed from ``_total``; it
    must be short (percentiles, histogram edges).
    """
    base, size = F.col("_base"), F.col("_n")
    wanted = buckets.where(size > 0).select(
        *keys, "_b", "_base", "_total",
        F.filter(targets, lambda t: (t["rank"] >= base) & (t["rank"] < base + size)).alias("_t"),
    ).where(F.size("_t") > 0)
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        counts.where((F.col("_valued") > 0) & all_of(*counts.columns)).select(*keys, "_b", "_v", "_c").join(wanted, [*keys, "_b"])
        .withColumn("_upto", F.col("_base") + F.sum("_c").over(inside))
    )
    below, upto = F.col("_upto") - F.col("_c"), F.col("_upto")
    hits = placed.select(*keys, "_total", "_v", F.explode(
        F.filter("_t", lambda t: (t["rank"] >= below) & (t["rank"] < upto))).alias("t"))
    return hits.select(*keys, "_total", F.col("t.name").alias("name"), F.col("t.rank").alias("rank"),
                       F.col("_v").alias("value"))


def percentile_rank(n: Column, p: float) -> Column:
    """Index of the percentile in a sorted list of n values."""
    return F.least(F.floor(n.cast("double") * p).cast("bigint"), n - 1)


def describe(
    df: DataFrame, keys: Sequence[str], value: Column, digits: int = 3,
    measures: Mapping[str, tuple[str, Column]] | None = None,
    quantiles: Mapping[str, float] | None = None,
) -> DataFrame:
    """Per group: ``rows``, measures, and count / avg / min / percentiles / max of the value.

    ``measures`` are further aggregates of the same pass, ``name -> (sum|total|min|max,
    column)``; ``total`` is a sum that can't overflow. Statistics are NULL for a group without values.
    """
    kinds = {n: kind for n, (kind, _) in (measures or {}).items()}
    return describe_counts(value_counts(df, keys, value, measures), keys, digits, kinds, quantiles)


def merge_counts(counts: DataFrame, keys: Sequence[str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Value counts of several parts, or of finer keys, as those of ``keys``: folding is associative."""
    return counts.groupBy(*keys, "_b", "_v").agg(
        F.sum("_c").alias("_c"), F.sum("_valued").alias("_valued"),
        *[(F.sum(n).cast("decimal(38,0)") if kind == "total" else _FOLD[kind](n)).alias(n) for n, kind in (kinds or {}).items()])


def describe_counts(
    counts: DataFrame, keys: Sequence[str], digits: int = 3,
    kinds: Mapping[str, str] | None = None, quantiles: Mapping[str, float] | None = None,
) -> DataFrame:
    """:func:`describe` from value counts; ``kinds`` names the measures they carry."""
    measures = {n: (kind, F.col(n)) for n, kind in (kinds or {}).items()}
    quantiles = QUANTILES if quantiles is None else quantiles
    buckets = _ranked_buckets(counts, keys, measures)
    targets = F.array(*[
        F.struct(F.lit(n).alias("name"), percentile_rank(F.col("_total"), p).alias("rank"))
        for n, p in quantiles.items()
    ])
    picks = pick_ranks(counts, buckets, keys, targets)
    # statistics and picked values meet in one grouping instead of a join
    partial = ["_n", "_rows", "_exact", "_inexact", "_plain", "_min", "_max", *measures]
    both = buckets.select(*keys, *partial).unionByName(
        picks.select(*keys, "name", F.col("value").alias("_pick")), allowMissingColumns=True)
    grouped = both.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.sum("_n").alias("count"),
        F.when(F.sum("_inexact") == 0, F.sum("_exact").cast("double")).otherwise(F.sum("_plain")).alias("_sum"),
        F.min("_min").alias("_lo"), F.max("_max").alias("_hi"),
        *[_FOLD[kind](n).alias(n) for n, (kind, _) in measures.items()],
        *[F.max(F.when(F.col("name") == n, F.col("_pick"))).alias(n) for n in quantiles],
    )
    mean = F.when(F.col("count") > 0, F.col("_sum") / F.col("count"))
    return grouped.select(
        *keys, F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        round_exact(mean, digits).alias("avg"),
        mean.alias("exact_avg"),
        round_exact(F.col("_lo"), digits).alias("min"),
        *[round_exact(F.col(n), digits).alias(n) for n in quantiles],
        round_exact(F.col("_hi"), digits).alias("max"),
        F.col("_hi").alias("exact_max"),
        *[_shown(n, kind) for n, (kind, _) in measures.items()],
    )


def describe_columns(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = (),
                     digits: int = 3) -> DataFrame:
    """:func:`describe` of several columns in one pass: one row per ``metric``."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in values.items()])
    long = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.metric", "p.v")
    return describe(long, [*by, "metric"], F.col("v"), digits)


def equal_count_histogram(df: DataFrame, value: Column, by: Sequence[str] = (), cap_steps: bool = True) -> DataFrame:
    """Buckets of equal row count: ``(bucket, upper, value)``.

    Step is ``max(1, n // min(n, 20))`` (or ``max(1, n // 20)``), so there are
    at most 39 buckets and each upper edge is one wanted rank.
    """
    counts = value_counts(df.where(value.isNotNull()), by, value)
    buckets = _ranked_buckets(counts, by, {})
    n = F.col("_total")
    step = F.greatest(F.lit(1), F.floor(n / (F.least(n, F.lit(20)) if cap_steps else F.lit(20)))).cast("bigint")
    edges = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / step).cast("bigint")),
        lambda k: F.struct(k.cast("string").alias("name"), (F.least((k + 1) * step, n) - 1).alias("rank")))
    picks = pick_ranks(counts, buckets, by, edges)
    k = F.col("name").cast("bigint")
    size = F.least((k + 1) * step, n) - k * step
    return picks.select(
        *by, k.alias("bucket"), round_exact(F.col("value"), 2).alias("upper"), size.alias("value")
    ).orderBy(*by, "bucket")


def equal_width_histogram(df: DataFrame, value: Column, by: Sequence[str] = (), buckets: int = 10) -> DataFrame:
    """Ten equal slices of [0, max], empty ones kept: ``(bucket, lower, upper, value)``."""
    counts = value_counts(df.where(value.isNotNull()), by, value)
    top = counts.groupBy(*by).agg(F.max(F.when(all_of(*counts.columns), F.col("_v"))).alias("_hi"))
    top = top.where(F.col("_hi").isNotNull())
    joined = counts.join(top, list(by)) if by else counts.crossJoin(F.broadcast(top))
    step = F.when(F.col("_hi") > 0, F.col("_hi") / float(buckets)).otherwise(F.lit(1.0))
    slot = F.greatest(F.lit(0), F.least(F.floor(F.col("_v") / step), F.lit(buckets - 1))).cast("int")
    filled = joined.where(all_of(*counts.columns)).groupBy(*by, slot.alias("bucket")).agg(F.sum("_c").alias("_n"))
    frame = top.select(*by, step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    out = frame.join(filled, [*by, "bucket"], "left")
    return out.select(
        *by, "bucket", round_exact(F.col("bucket") * F.col("_step"), 1).alias("lower"),
        round_exact((F.col("bucket") + 1) * F.col("_step"), 1).alias("upper"),
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("value"),
    ).orderBy(*by, "bucket")


# fixed values: duration classes in milliseconds
DURATION_CLASSES = [
    ("< 1ms", 0.0, 1.0), ("1-10ms", 1.0, 10.0), ("10-50ms", 10.0, 50.0), ("50-100ms", 50.0, 100.0),
    ("100-500ms", 100.0, 500.0), ("500ms-1s", 500.0, 1000.0), ("1-5s", 1000.0, 5000.0), ("> 5s", 5000.0, None),
]


def duration_classes(df: DataFrame, millis: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows per fixed duration class, empty classes left out."""
    label, order = None, None
    for i, (name, low, high) in enumerate(DURATION_CLASSES):
        cond = (millis >= low) if high is None else (millis >= low) & (millis < high)
        label = F.when(cond, name) if label is None else label.when(cond, name)
        order = F.when(cond, i) if order is None else order.when(cond, i)
    return (
        df.select(*by, order.alias("_o"), label.alias("label")).where(F.col("_o").isNotNull())
        .groupBy(*by, "_o", "label").agg(F.count("*").alias("value")).orderBy(*by, "_o").drop("_o")
    )
