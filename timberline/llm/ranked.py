"""Ranked lexical search for many queries at once by shared term sets.

1. Postings. One pass over the texts keeps of every document its id, its number of terms and, as two short arrays,
   which query terms it holds and how often. Document counts are folded on the way and summed per term.
2. Mining. Terms that the same items hold are one set; then, as in common-subexpression elimination, the pair of sets that most items
   hold together becomes a set of its own and takes the pair's place in those items, until no pair is held twice. What comes out is
   a graph without cycles: terms, shared sets (each the union of two others), items (unions of what is left to them).
3. Evaluation. Documents are taken in blocks. A term's accumulator is its contribution to each document of the block; a
   set's is the sum of its two parts, made once and used by every set and item above it, and let go after the last use. An item's
   accumulator is its scores.
4. Ranking. A task keeps the best `k` of each item over all its blocks; those few rows are shuffled by item and a number
   from the id, cut to `k` again, and then by item.

Items are taken `most_items` at a time (by id), so what the driver holds and mines is bounded, as is the graph a task holds; documents
are never gathered by term or item. Everything in a score is whole numbers.

Defined results: null text has no terms and never ranks; rows with one item_id are one item with the terms of all of them; an item
without terms, or whose terms no document holds, has no rows; rows that repeat a doc_id are ranked each; a null doc_id
comes after others of equal score; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import common

_CELLS = 1 << 22  # terms times documents evaluated at a time
_LONG = 512  # an item with more nodes than this takes the sets that others share, and proposes none
# ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest parts terms
_LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
FOUND = "item bigint, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode().translate(_LETTERS).split()


@dataclass
class Graph:
    """Nodes 0..n_terms - 1 are terms; node n_terms + i is the union of pairs[i]; items are unions of nodes."""

    n_terms: int
    pairs: list[tuple[int, int]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)

    def uses(self) -> np.ndarray:
        count = np.zeros(self.n_terms + len(self.pairs), dtype=np.int64)
        for nodes in (*self.pairs, *self.items):
            for node in nodes:
                count[node] += 1
        return count

    def terms_of(self, node: int) -> list[int]:
        """The terms under a node."""
        return [node] if node < self.n_terms else [t for part in self.pairs[node - self.n_terms] for t in self.terms_of(part)]


def mine(items: list[list[int]], n_terms: int) -> Graph:
    """The sharing graph of items, each a list of distinct terms."""
    graph = Graph(n_terms)

    def union(a: int, b: int) -> int:
        graph.pairs.append((a, b))
        return n_terms + len(graph.pairs) - 1

    def chain(nodes: list[int]) -> int:
        out = nodes[0]
        for node in nodes[1:]:
            out = union(out, node)
        return out

    holders: dict[int, list[int]] = defaultdict(list)
    for i, own in enumerate(items):
        for t in own:
            holders[t].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t in sorted(holders):
        alike[tuple(holders[t])].append(t)
    left: list[set[int]] = [set() for _ in items]
    for who, group in alike.items():
        # terms of one item alone are shared by nobody and stay as they are
        for node in [chain(group)] if len(who) > 1 else group:
            for i in who:
                left[i].add(node)
    shared: dict[int, set[int]] = defaultdict(set)
    for i, own in enumerate(left):
        for node in own:
            shared[node].add(i)
    together = Counter((a, b) for own in left if len(own) <= _LONG for a in own if len(shared[a]) > 1
                       for b in own if a < b and len(shared[b]) > 1)
    heap = [(-n, pair) for pair, n in together.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = shared[a] & shared[b]
        if len(both) != -n:  # others took some of them meanwhile
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), (a, b)))
            continue
        made = union(a, b)
        shared[a] -= both
        shared[b] -= both
        shared[made] = both
        near: Counter[int] = Counter()
        for i in both:
            left[i] -= {a, b}
            if len(left[i]) <= _LONG:
                near.update(left[i])
            left[i].add(made)
        for other, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, (other, made)))
    graph.items = [sorted(own) for own in left]
    return graph


def evaluate(graph: Graph, impact: np.ndarray, uses: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of all documents of a block) from the terms' accumulators, one row of `impact` each."""
    made: dict[int, np.ndarray] = {}
    open_uses = uses.copy()

    def take(node: int) -> np.ndarray:
        open_uses[node] -= 1
        if node < graph.n_terms:
            return impact[node]
        return made[node] if open_uses[node] else made.pop(node)

    waiting: dict[int, list[int]] = defaultdict(list)
    for i, nodes in enumerate(graph.items):
        if nodes:
            waiting[max(max(nodes), graph.n_terms - 1)].append(i)

    def items_at(node: int) -> Iterator[tuple[int, np.ndarray]]:
        for i in waiting.get(node, ()):
            total = np.zeros(impact.shape[1], dtype=np.int64)
            for part in graph.items[i]:
                total += take(part)
            yield i, total

    yield from items_at(graph.n_terms - 1)
    for i, (a, b) in enumerate(graph.pairs):
        made[graph.n_terms + i] = take(a) + take(b)
        yield from items_at(graph.n_terms + i)


def postings(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text), term (places in `names` that it holds, ascending) and tf."""
    own = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = own.value.get
        for batch in batches:
            if not batch.num_rows:
                continue
            n, found, tf, lengths = [], [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py())
                n.append(len(words))
                at, counts = np.unique(np.array([p for p in map(place, words) if p is not None], dtype=np.int32), return_counts=True)
                found.append(at)
                tf.append(counts)
                lengths.append(lengths[-1] + len(at))
            offsets = pa.array(lengths, pa.int32())

            def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), kind))

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), lists(found, pa.int32()), lists(tf, pa.int64())],
                                             names=["doc_id", "n", "term", "tf"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def statistics(held: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """(documents with a term, terms in all, documents that hold each query term)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
            df += np.bincount(batch.column("term").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([docs, length, *df[at].tolist()], pa.int64())],
                                         names=["term", "n"])

    # one row per query term comes back: bounded by the block of items
    sums = dict(held.select("n", "term").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())
    return sums.get(-2, 0), sums.get(-1, 0), [sums.get(t, 0) for t in range(n_terms)]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impact(n: np.ndarray, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """The terms' accumulators for one block of documents."""
    m = 100 - 50 + (50 * n * n_docs) // max(length, 1)
    of = np.repeat(np.arange(len(n)), np.diff(offsets))
    out = np.zeros((len(weights), len(n)), dtype=np.int64)
    out[term, of] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
    return out


def _best(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, null ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], null[at], -scores[at]))][:k]


def scored(held: DataFrame, graph: Graph, weights: list[int], n_docs: int, length: int, k: int) -> DataFrame:
    """The best k documents of each item in each partition of the postings: item (its place), doc_id, score."""
    context = held.sparkSession.sparkContext
    shared = context.broadcast((graph, graph.uses(), np.array(weights, dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, uses, w = shared.value
        none, block = np.zeros(0, dtype=np.int64), max(16, min(1024, _CELLS // max(1, sets.n_terms)))
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                lists = part.column("term")
                first = lists.offsets.to_numpy()
                impact = _impact(part.column("n").to_numpy(), first, lists.flatten().to_numpy(),
                                 part.column("tf").flatten().to_numpy(), w, n_docs, length)
                for item, scores in evaluate(sets, impact, uses):
                    held_ids, held_null, held_scores = best.get(item, (none, none.astype(bool), none))
                    if len(held_scores) == k:
                        new = np.flatnonzero(scores >= max(1, held_scores[-1]))
                    else:
                        new = np.flatnonzero(scores)
                    if not len(new):
                        continue
                    rows = (np.concatenate([held_ids, ids[new]]), np.concatenate([held_null, null[new]]), np.concatenate([held_scores, scores[new]]))
                    own = _best(*rows, k)
                    best[item] = tuple(c[own] for c in rows)
        for item in sorted(best):
            ids, null, scores = best[item]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(scores)], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, FOUND)


def _item_blocks(items: DataFrame, most_items: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of at most `most_items` items, by ascending id."""
    folded = common.stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy(
        "item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("text"))).alias("text")), "items")
    wholly = folded.withColumn("place", F.row_number().over(Window.orderBy("item_id")) - 1).select("item_id", "place")
    places = common.stored(wholly, "places")
    count = places.count()
    for at in range(0, count, most_items):
        own = places.where((F.col("place") >= at) & (F.col("place") < at + most_items))
        rows = folded.join(own, folded["item_id"].eqNullSafe(own["item_id"])).select(folded["item_id"], "text").collect()
        yield sorted(((r["item_id"], sorted(set(terms(r["text"])))) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def search(docs: DataFrame, items: DataFrame, k: int = 50, most_items: int = 512) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    found = []
    for block in _item_blocks(items, most_items):
        names = sorted({t for _, own in block for t in own})
        place = {t: i for i, t in enumerate(names)}
        held = common.stored(postings(docs, names), "postings")
        n_docs, length, df = statistics(held, len(names))
        graph = mine([[place[t] for t in own] for _, own in block], len(names))
        rows = scored(held, graph, [weight(n_docs, d) for d in df], n_docs, length, k)
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item bigint, item_id bigint")
        # two cuts: a part of an item's rows, then all of them
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        parts = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
        few = rows.withColumn("place", F.row_number().over(parts)).where(F.col("place") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
