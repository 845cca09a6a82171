"""Quality rules: exact counts per document, and robust multivariate outliers per language and source.

The counts of `measures` decide the base rules. `features` turns them into a vector on a bounded integer grid, so sums
and products are exact and reruns agree. Every document lies in one cell: its (language, source), the rest of its
language where that pair has under `least_docs` documents, or the rest of all. Per cell the minimum-covariance-
determinant estimate is found by concentration steps: from medians and spreads, take the `share` of documents nearest to
the centre, estimate mean and covariance from them, and again. One step is one fold of all vectors to
(cell, distance bin) sums with map-side combining, so a cell with a third of all documents is at most `_BINS` rows per
task; no cell is gathered. A document is rejected if its squared Mahalanobis distance is above `cutoff`, which is by default
three times the 0.999 point of the chi-square distribution, since texts have heavier tails than normal vectors.

Only documents that pass the base rules take part in the estimate and can be outliers. A cell with under `least_docs`
documents after pooling rejects nobody. Most texts have no symbol, repeat or double line at all, so the share of these is taken with
some imaginary clean words or lines added: one repeat in a short text is then a small share, and variances have a floor
far below the spreads of the other statistics (half to a fifth of them and less), so that a constant does not make every deviation an
outlier. Every statistic is clamped to 8 (8000 grid units), which only a mean word length of over 2,900 letters reaches.

Defined results: null or blank text has no words and fails the base rules; null language or source is a value of its own;
an empty table gives an empty result; only id, text, lang, source and the columns in `carry` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import common

# the vector: name and the least standard deviation, in grid units of 1/1000
FLOOR = {"length": 5, "symbols": 10, "lines": 15, "repeats": 15, "capitals": 5, "variety": 5}
_CLEAN_LINES, _CLEAN_WORDS = 20, 200  # added to a text's own when shares of double lines and repeats are taken
_BINS = 64
_GRID = 1000
_SMALL = 64  # so many repeated windows are looked up one by one; more are found by sorting


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, `carry`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", *carry, text.alias("doc_text")).withColumn(
        "words", common.word_array(F.col("doc_text")))
    solid = F.array_join("words", "")
    blankless = F.filter(F.split("doc_text", "\n", -1), lambda x: F.btrim(x, F.lit(common.SPACES)) != "")
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"), "solid": solid, "full_lines": blankless,
        "n_kinds": F.size(F.array_distinct("words")).cast("long"),
        "windows": F.when(F.size("words") >= 3, F.transform(
            F.sequence(F.lit(1), F.size("words") - 2),
            lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))))
        .otherwise(F.array().cast("array<bigint>"))})
    rows = rows.withColumn("uniform", F.size(F.array_distinct("windows")) == F.size("windows"))
    # windows that occur again: neighbours in sorted order
    rows = rows.withColumn("ordered", F.when(F.col("uniform"), F.array().cast("array<bigint>")).otherwise(F.sort_array("windows")))
    rows = rows.withColumn("again", F.array_distinct(F.filter(
        "ordered", lambda x, i: (i > 0) & (x == F.get("ordered", F.greatest(i - 1, F.lit(0)))))))

    def covered(places: Column) -> Column:
        """Words under windows at ascending places: each adds those that the one before doesn't reach."""
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    few = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull())
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size("again") > _SMALL, placed))
    many = F.sort_array(F.transform(F.filter("placed", lambda x, j: (
        (j > 0) & (x["h"] == F.get("placed", F.greatest(j - 1, F.lit(0)))["h"]))
        | F.coalesce(x["h"] == F.get("placed", j + 1)["h"], F.lit(False))), lambda x: x["i"]))
    repeat = F.when(F.col("uniform"), 0).when(F.size("again") <= _SMALL, covered(few)).otherwise(covered(many))
    return rows.select(
        "doc_id", "lang", "source", *carry, "n_words", F.char_length("solid").cast("long").alias("word_chars"),
        F.regexp_count("solid", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.size("full_lines").cast("long").alias("n_full_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.regexp_count("solid", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"), "n_kinds")


def base_failed(least_words: int = 50, most_repeat: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))


def _features(rows: DataFrame) -> DataFrame:
    """Adds the transformed statistics as whole numbers of thousandths, each between 0 and a few thousand."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = {
        "length": F.log(chars / words), "symbols": F.log1p(20 * F.col("n_symbols") / chars),
        "lines": F.col("n_dup_lines") / (F.col("n_full_lines") + _CLEAN_LINES),
        "repeats": F.col("n_repeat_words") / (words + _CLEAN_WORDS), "capitals": F.log1p(20 * F.col("n_capitals") / chars),
        # the share of distinct words falls with length; the exponent of Herdan's law falls much less
        "variety": F.log(F.greatest("n_kinds", F.lit(1))) / F.log(F.greatest(words, F.lit(2)))}
    return rows.withColumns({f"x_{k}": F.least(F.round(v * _GRID), F.lit(8000)).cast("long") for k, v in vector.items()})


def _cells(rows: DataFrame, least_docs: int) -> DataFrame:
    """Adds `cell`. Counts come from the documents that pass the base rules; one row per pair of language and source."""
    pair = F.to_json(F.struct("lang", "source"))
    rows = rows.withColumn("pair", pair).withColumn("tongue", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")))
    pairs = rows.groupBy("pair", "tongue").agg(F.count_if(~F.col("base_failed")).alias("n"))
    small = F.col("n") < least_docs
    rest = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("tongue"))
    pairs = pairs.select("pair", F.when(~small, F.col("pair")).when(rest >= least_docs, F.concat(F.lit("lang"), "tongue"))
                         .otherwise(F.lit("rest")).alias("cell"))
    return rows.join(pairs, "pair").drop("pair", "tongue")


def _chi2(x: float, k: int) -> float:
    """The chi-square distribution with k degrees of freedom."""
    a, total = k / 2, 0.0
    term = 1 / a
    for i in range(1, 400):
        total += term
        term *= x / 2 / (a + i)
    return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))


def chi2_point(share: float, k: int) -> float:
    """Where the distribution reaches `share`."""
    low, high = 1e-6, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < share else (low, mid)
    return low


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the nearest `share` of normal vectors consistent: share / P(chi2_{p+2} <= q)."""
    return share / _chi2(chi2_point(share, p), p + 2)


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor l_i_j and the means m_i."""
    z: list[Column] = []
    for i, name in enumerate(names):
        d = F.col(f"x_{name}") - F.col(f"m_{i}")
        for j in range(i):
            d = d - F.col(f"l_{i}_{j}") * z[j]
        z.append(d / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _cholesky(moments: DataFrame, names: list[str], scale: float) -> DataFrame:
    """(cell, n, m_i, l_i_j) from exact sums n, s_i, s_i_j."""
    p, n = len(names), F.col("n").cast("double")
    rows = moments.select("cell", "n", "in_cell", *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(p)], *[
        (F.greatest((F.col(f"s_{i}_{j}") - F.col(f"s_{i}").cast("double") * F.col(f"s_{j}") / n) / n, F.lit(0.0)) * scale + FLOOR[names[i]] ** 2
         if i == j else (F.col(f"s_{i}_{j}") - F.col(f"s_{i}").cast("double") * F.col(f"s_{j}") / n) / n * scale).alias(f"c_{i}_{j}")
        for i in range(p) for j in range(i + 1)])
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}")
            rows = rows.withColumn(f"l_{i}_{j}", value)
    return rows.select("cell", "in_cell", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def estimates(vectors: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """The estimate per cell, (cell, in_cell, m_i, l_i_j), from rows (cell, x_...)."""
    names = list(FLOOR)
    p = len(names)
    # values lie on a bounded grid, so exact percentiles hold at most a few thousand counts per cell
    middle = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"), *[
        F.percentile(f"x_{k}", [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, k in enumerate(names)])
    state = middle.select("cell", "in_cell", *[F.get(f"q_{i}", F.lit(1)).alias(f"m_{i}") for i in range(p)], *[
        (F.sqrt(F.pow((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, 2) + FLOOR[k] ** 2) if i == j
         else F.lit(0.0)).alias(f"l_{i}_{j}") for i, k in enumerate(names) for j in range(i + 1)])
    for _ in range(steps):
        state = common.stored(state, "estimate")
        # distances in bins that get wider: 8 to a doubling
        rows = vectors.join(state, "cell").withColumn("bin", F.least(F.floor(
            8 * F.log2(1 + _distance(names))), F.lit(_BINS - 1)).cast("int"))
        bins = rows.groupBy("cell", "bin").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"x_{a}").alias(f"s_{i}") for i, a in enumerate(names)],
            *[F.sum(F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"s_{i}_{j}")
              for i, a in enumerate(names) for j, b in enumerate(names[:i + 1])])
        sums = [c for c in bins.columns if c not in ("cell", "bin")]
        nearer = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("cell")
        kept = bins.withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn(
            "in_cell", F.sum("n").over(whole)).where(F.col("nearer") < share * F.col("in_cell"))
        state = _cholesky(kept.groupBy("cell").agg(F.first("in_cell").alias("in_cell"), *[F.sum(c).alias(c) for c in sums]),
                          names, consistency(share, p))
    return common.stored(state, "estimate")


def distances(rows: DataFrame, least_docs: int = 100, share: float = 0.75, steps: int = 4) -> DataFrame:
    """Adds `distance` to rows with cell, base_failed and the vector; null where the base rules fail or the cell is too small."""
    passed = rows.where(~F.col("base_failed")).select("cell", *[f"x_{k}" for k in FLOOR])
    state = estimates(passed, share, steps).where(F.col("in_cell") >= least_docs)
    return rows.join(state, "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(list(FLOOR))))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = (), least_docs: int = 100, share: float = 0.75, steps: int = 4,
                  cutoff: float | None = None) -> DataFrame:
    """One row per document: doc_id, lang, source, `carry`, the counts, base_failed, distance (null where there is no
    estimate or the base rules fail) and kept."""
    most = 3 * chi2_point(0.999, len(FLOOR)) if cutoff is None else cutoff
    rows = _features(measures(docs, carry).withColumn("base_failed", base_failed()))
    rows = _cells(common.stored(rows, "measures"), least_docs)
    return distances(rows, least_docs, share, steps).select(
        "doc_id", "lang", "source", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= most, F.lit(True))).alias("kept"))
