"""Near copies by shared shingles: every pair of texts whose shingle sets have a Jaccard similarity of `least` or more.

Candidates come from two sides and each is confirmed on the words themselves. SimHash links bring close copies together
cheaply. Prefix keys make the search complete: in one order of all shingles, two sets of n and m members with similarity s or more
share one among the first n - ceil(s * n) + 1 and m - ceil(s * m) + 1, and from the first shared one on there is room for
ceil((n + m) * s / (1 + s)) of them. So no pair is left to chance, whatever its similarity. Any order is right; this one puts
shingles last that many texts hold: texts are counted in `_BUCKETS` hash buckets (a first pass; the table has a fixed size and is
sent to all tasks), and a shingle stands by its bucket's count, then its hash. A passage that a third of all texts share is a key
only of texts with next to nothing else.

Groups of near copies are not listed pair by pair. First each holder of a prefix key meets the key's least holder only; the
confirmed links become components. Then the holders of a key meet if they are not yet in one component, so what
remains of a large group is a few pairs between its parts. Before any text is joined, pairs go that cannot be similar: by size
(the smaller set has at least s times the members of the larger), and by a sketch that has the parity of the members that fall on each
bit, so two sets differ in at least as many members as bits. Only texts of pairs that are left are read again.

Equal texts are folded to one class first. No window or group holds the rows of a key: keys are counted and their least holder found
with map-side combining, and joins on a key are plain joins that Spark splits by size.

Defined results: null, empty and blank texts are one class; a text shorter than a shingle is one shingle; a null id keeps its row
and its component has the least non-null id (null if there is none); repeated rows stay rows; of a component, the row with the
least id stays (null ids last; equal ids by the hash of the text); an empty table gives an empty result; only the id, the text and
the columns in `carry` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import common, simhash
from timberline.llm.components import components

_SLACK = 1e-9  # rounding of least * n
_SKETCH = [f"s{i}" for i in range(8)]  # longs
_BUCKETS = 1 << 20
_CHUNK = 1 << 14  # buckets that travel in one row


def class_key(text: Column) -> Column:
    """One long per text; the same for all texts without words."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.when(F.btrim(text, F.lit(common.SPACES)) == "", F.lit("")).otherwise(text))


def similarity(a: str | None, b: str | None, words_each: int = 5) -> float:
    """Jaccard similarity of the sets of shingles; 1 for two texts without words."""
    x, y = shingles(a, words_each), shingles(b, words_each)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def shingles(text: str | None, words_each: int = 5) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(min(words_each, max(1, len(words)))))))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BUCKETS.bit_length() + 1)).astype(np.int64)


def bucket_counts(rows: DataFrame, words_each: int) -> np.ndarray:
    """How many texts hold a shingle of each bucket, a text once per distinct shingle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, bucket_of(np.unique(simhash.shingle_hashes(text.as_py(), words_each))), 1)
        chunks = [i for i in range(_BUCKETS // _CHUNK) if counts[i * _CHUNK:(i + 1) * _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([
            pa.array(chunks, pa.int32()), pa.array([counts[i * _CHUNK:(i + 1) * _CHUNK].tobytes() for i in chunks], pa.binary())], names=["chunk", "counts"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    found = rows.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(fold, schema)
    out = np.zeros(_BUCKETS, dtype=np.int64)
    for chunk, counts in found.collect():  # `_BUCKETS` numbers, whatever the input
        out[chunk * _CHUNK:(chunk + 1) * _CHUNK] += np.frombuffer(counts, dtype=np.int64)
    return out


def prints(rows: DataFrame, words_each: int, least: float) -> DataFrame:
    """key, n (distinct shingles), fp, prefix (the first hashes in order) and the sketch of (key, text)."""
    bits = 64 * len(_SKETCH)
    counts = rows.sparkSession.sparkContext.broadcast(np.minimum(bucket_counts(rows, words_each), 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_ones = counts.value
        for batch in batches:
            sizes, fps, prefixes, sketches = [], [], [], []
            for text in batch.column("text"):
                hashes = simhash.shingle_hashes(text.as_py(), words_each)
                ordered = np.unique(hashes)
                ordered = ordered[np.argsort(common_ones[bucket_of(ordered)], kind="stable")]
                sizes.append(len(ordered))
                fps.append(simhash.majority(hashes))
                parity = np.bincount((ordered % bits).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                sketches.append(np.packbits(parity, bitorder="little").view(np.int64))
                prefixes.append(ordered[:len(ordered) - math.ceil(least * len(ordered) - _SLACK) + 1].view(np.int64))
            sketch = np.array(sketches, dtype=np.int64).reshape(-1, len(_SKETCH)).T
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(sizes, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                pa.array(prefixes, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(x)) for x in sketch)],
                names=["key", "n", "fp", "prefix", *_SKETCH])

    return rows.select("key", "text").mapInArrow(run, ", ".join(["key long, n int, fp long, prefix array<bigint>", *(f"{c} long" for c in _SKETCH)]))


def possible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The distinct (a, b) whose sizes and sketches allow the similarity."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in _SKETCH))

    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(least) & _sketches_fit(least)).select("a", "b")


def _sizes_fit(least: float) -> Column:
    return F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - F.lit(_SLACK)


def confirmed(pairs: DataFrame, texts: DataFrame, words_each: int, least: float) -> DataFrame:
    """The (a, b) of pairs of keys whose texts are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(a.as_py(), b.as_py(), words_each) >= least - _SLACK for a, b in zip(batch.column("ta"), batch.column("tb"))]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    sides = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return sides.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def close_copies(classes: DataFrame) -> DataFrame:
    """(a, b): candidates of SimHash, the least key of a fingerprint standing for the others."""
    firsts = classes.groupBy("fp").agg(F.min("key").alias("first"))
    found = simhash.links(firsts.select("fp"))
    across = found.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a").join(
        firsts.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b").select(*_ordered(F.col("fa"), F.col("fb")))
    same = classes.join(firsts, "fp").where("key <> first").select(*_ordered(F.col("key"), F.col("first")))
    return across.unionByName(same)


def _sketches_fit(least: float) -> Column:
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH), F.lit(0))
    return differ <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - least) / (1 + least)) + F.lit(_SLACK)


def _confirmed_of(pairs: DataFrame, docs: DataFrame, words_each: int, least: float) -> DataFrame:
    """The links among stored pairs; reads the texts of their classes only, one of each."""
    wanted = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    texts = docs.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return common.stored(confirmed(pairs, common.stored(texts, "texts"), words_each, least), "links")


def roots_of(docs: DataFrame, words_each: int, least: float) -> DataFrame:
    """(node, root) of the keys of docs (key, text) that have a near copy."""
    classes = common.stored(prints(docs.select("key", "text"), words_each, least).groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("n", "fp", "prefix", *_SKETCH))), "classes")
    # prefix keys with several holders; most have one
    shared = common.stored(classes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where(
        "held > 1").select("shingle"), "shared")
    holders = common.stored(classes.select("key", "n", F.posexplode("prefix").alias("place", "shingle")).join(
        shared, "shingle", "left_semi"), "holders")
    firsts = holders.groupBy("shingle").agg(F.min("key").alias("a"), F.min_by("n", "key").alias("n_a"))
    stars = holders.join(firsts, "shingle").where("key <> a").select("a", F.col("key").alias("b"), "n_a", F.col("n").alias("n_b"))
    stars = stars.where(_sizes_fit(least)).select("a", "b")
    first = common.stored(possible(stars.unionByName(close_copies(classes)), classes, least), "candidates")
    links = _confirmed_of(first, docs, words_each, least)
    roots = components(links)
    named = holders.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = common.stored(named.join(classes.select("key", *_SKETCH), "key"), "named")
    x = named.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("key", "n", "place", "root", *_SKETCH)))
    y = named.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "place", "root", *_SKETCH)))
    room = 1 + F.least(F.col("n_a") - 1 - F.col("place_a"), F.col("n_b") - 1 - F.col("place_b"))
    fits = room >= (F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - F.lit(_SLACK)
    # all tests are part of the join: what it gives are pairs that may well be similar
    open_pairs = x.join(y, "shingle").where("key_a < key_b and root_a <> root_b").where(_sizes_fit(least) & fits & _sketches_fit(least))
    open_pairs = open_pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    more = common.stored(open_pairs.join(first, ["a", "b"], "left_anti"), "candidates")
    if more.isEmpty():
        return roots
    return components(links.unionByName(_confirmed_of(more, docs, words_each, least)))


def near_copies(docs: DataFrame, carry: tuple[str, ...] = (), words_each: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, `carry`, key (of its text), component_id (the least doc_id that links reach) and stays:
    whether (doc_id, key) is the one of its component that stays."""
    rows = docs.withColumn("key", class_key(F.col("text"))).select("doc_id", *carry, "key", "text")
    roots = roots_of(rows, words_each, least)
    named = rows.drop("text").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    components_of = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(
        F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return named.join(components_of, "root").select("doc_id", *carry, "key", "component_id", stays.alias("stays"))
