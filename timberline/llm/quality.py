"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once and written to the shared folder, so training and scoring read
numbers. The trees are fitted in the driver on a bounded sample of labelled rows (`most_rows`, the rows with the smallest
hash of their id) and flattened into arrays (feature, threshold, left, right, value); tasks walk all rows of a batch
through all trees with numpy, one level at a time.

Defined results: null, empty and blank texts have statistics of zero and get a score like any other; a document with
several labels teaches each; rows with a null label teach nothing; without any label every score is 0.5; repeated rows
are scored each; an empty table gives an empty result; only the id, the text and the columns in `carry` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm import common

STATISTICS = (
    "log_words", "mean_word", "sd_word", "longest_word", "distinct_words", "top_word", "repeated_pairs", "repeated_triples",
    "lines", "words_per_line", "distinct_lines", "short_lines", "capitals", "digits", "symbols", "stops", "other_marks",
    "blanks", "non_ascii", "ends_with_mark", "words_with_letter", "caps_words", "mark_ends", "byte_entropy",
)
# fixed values: characters of the byte classes
_CLASSES = {"capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]@^~=+_\\",
            "stop": b".!?", "mark": b",;:-'\"()/", "blank": b" \t\n\x0b\f\r"}
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[np.frombuffer(_chars, dtype=np.uint8)] = _i
_CLASS_OF[128:] = len(_CLASSES) + 1


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(raw, dtype=np.uint8)
    by_byte = np.bincount(codes, minlength=256)
    kinds = np.bincount(_CLASS_OF, weights=by_byte, minlength=len(_CLASSES) + 2) / len(raw)
    lengths = np.array([len(w) for w in words])
    n = len(words)
    ids: dict[bytes, int] = {}
    coded = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pairs = coded[:-1] * n + coded[1:]
    distinct_pairs, pairs = np.unique(pairs, return_inverse=True)  # codes under n: no product below overflows
    triples = pairs[:-1] * n + coded[2:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = by_byte[by_byte > 0] / len(raw)
    lasts = _CLASS_OF[np.array([w[-1] for w in words], dtype=np.uint8)]
    letters = sum(1 for w in ids if any(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w)) / len(ids)
    caps = sum(w.isupper() for w in words) / n
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())), len(ids) / n,
        float(np.bincount(coded).max()) / n, 1 - len(distinct_pairs) / len(pairs) if n > 1 else 0.0,
        1 - len(np.unique(triples)) / len(triples) if n > 2 else 0.0, math.log1p(len(lines)), math.log1p(n / len(lines)),
        len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), *kinds[1:].tolist()[:5], float(kinds[6]),
        float(kinds[7]), float(raw.rstrip()[-1:] in b".!?"), letters, caps, float((lasts == 3).mean() + (lasts == 4).mean()),
        float(-(share * np.log2(share)).sum()),
    ]


def with_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `carry` and stats, the array of STATISTICS."""
    rows = docs.select("doc_id", *carry, "text")
    kept = rows.columns[:-1]
    schema = rows.select(*kept).schema.add("stats", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), stats], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Forest:
    """Trees of one depth, flattened: node k of a tree has its children at 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; a row goes right if its value is above
    value: np.ndarray  # trees x leaves
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at_row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[at_row, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
          ridge: float = 2.0, least_weight: float = 1.0) -> Forest:
    """Newton boosting of the log loss. Features are binned once; a level of a tree is one histogram over (node, feature, bin)."""
    n, p = x.shape if x.size else (0, len(STATISTICS))
    inner = 2**depth - 1
    if n == 0:
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], axis=1)
    cuts = np.full((p, bins), np.inf)
    for j, own in enumerate(edges):
        cuts[j, :len(own)] = own
    usable = np.isfinite(cuts)
    flat = binned + np.arange(p) * bins
    raw, features, thresholds, values = np.full(n, base), [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (p * bins) + flat).ravel()
            sums_g = np.bincount(at, np.repeat(g, p), width * p * bins).reshape(width, p, bins)
            sums_h = np.bincount(at, np.repeat(h, p), width * p * bins).reshape(width, p, bins)
            left_g, left_h = sums_g.cumsum(axis=2), sums_h.cumsum(axis=2)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g)**2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[~np.broadcast_to(usable, gain.shape) | (left_h < least_weight) | (all_h - left_h < least_weight)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // bins, best % bins
            feature[first:first + width] = f
            threshold[first:first + width] = np.where(found, cuts[f, b], np.inf)
            own = node - first
            node = 2 * node + 1 + (found[own] & (binned[np.arange(n), f[own]] > b[own]))
        leaf = node - inner
        leaves = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += leaves[leaf]
        features.append(feature), thresholds.append(threshold), values.append(leaves)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def labelled_sample(labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """(doc_id, y): at most `most_rows` labelled rows, those with the smallest hash of the id."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return rows.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "y").limit(most_rows)


def first_rows(rows: DataFrame, row_hash: Column, most: int) -> pd.DataFrame:
    """The first rows by hash of the id, id, label and `row_hash`: the same ones in every run, also where ids repeat."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"), row_hash]
    return rows.orderBy(*order).limit(most).toPandas().sort_values("doc_id", kind="stable")


def classify(docs: DataFrame, labels: DataFrame, train: Column, carry: tuple[str, ...] = (), label: str = "quality",
             most_rows: int = 20_000) -> DataFrame:
    """doc_id, `carry`, stats, score for every row of docs. `train` (on doc_id) tells which labels may be used."""
    rows = common.stored(with_statistics(docs, carry), "statistics")
    sample = labelled_sample(labels.where(train), label, most_rows)
    # the sample has a proven size, so it is sent to the statistics
    got = first_rows(rows.select("doc_id", "stats").join(F.broadcast(sample), "doc_id"), F.xxhash64("stats"), 2 * most_rows)
    x = np.stack(got["stats"].to_list()).astype(np.float64) if len(got) else np.zeros((0, len(STATISTICS)))
    forest = docs.sparkSession.sparkContext.broadcast(boost(x, got["y"].to_numpy(dtype=float)))
    schema = rows.select("*").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch.column(batch.schema.get_field_index("stats"))
            values = stats.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.score(values))], names=schema.names)

    return rows.mapInArrow(run, schema)
