"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Nearness is the inner product. Vectors are divided by the greatest norm and get one more component that makes
all norms equal, which leaves inner products with a query (whose extra component is 0) as they are and makes nearness
between rows a metric one. Equal vectors are folded to one node before anything else. Where norms differ much that component
would hide all else, so there is a graph per octave of norms (`_BANDS` at most, the last for all shorter ones), each scaled by
its own greatest norm. A query joins the graphs of other octaves as a guest, with its direction, and searches each.

Build. Random hyperplanes through the mean of all nodes put them into cells (`trees` times); a cell of more than `cell` nodes is
dealt at random into pieces of about that size before anything is shuffled, and each piece gives first neighbours. Then rounds of NN-descent: every node is the pivot of a group of its neighbours and of nodes that have it as
neighbour (at most `group`, new ones first); members of a group are compared with each other, and each learns of
those that beat its own last neighbour. A node that very many others name keeps `group` of them per map task and `group` in
all (the rank limit stands right above the window, so Spark cuts before the shuffle), and what a node learns is cut to its best `k` per
512 pivots before it travels. Groups come from joins and one shuffle; what a task holds is one batch of bounded groups.

Search. All queries walk at once: a beam of `beam` nodes per query; every hop joins the neighbours of the best nodes not
yet opened, both ways of an edge (backwards the `back` nearest), and keeps the best, until no beam has one left or `hops` are done. The found nodes are compared exactly, in
double precision on the original vectors.

The index holds every row; nothing is sampled. Defined results: vectors that are null, empty, zero or hold null or
non-finite components, or have another length than most, take no part, as query or candidate; null ids take no part;
rows that repeat an id count once (the first vector in sort order); ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty result. The graph holds half-precision numbers: vectors
over two hundred million times shorter than the longest are zero in it and found by chance only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import common

_HALF = np.float16
_ROWS = 1 << 14
_BANDS = 16


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the key."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys != keys[-1], False, side="left")) if keys[0] == keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if cut and keys[0] != keys[-1]:
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut)
        rest = table
    if rest is not None:
        yield rest.combine_chunks()


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_HALF).reshape(-1, dims).astype(np.float32)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All list items, and the row of each; a null list is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return array.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(array)), lengths)


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists per row 0..n-1 from values sorted by row."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, embedding): distinct vectors, named by their least id."""
    return vectors.groupBy("embedding").agg(F.min("vec_id").alias("node")).select("node", "embedding")


def banded(nodes: DataFrame) -> tuple[DataFrame, list[int], float, int]:
    """(node, embedding, band), the bands that occur, the greatest norm, and the length of extended vectors."""
    norm = F.sqrt(_inner("embedding", "embedding"))
    facts = nodes.select(norm.alias("norm"), F.size("embedding").alias("dims")).agg(
        F.max("norm").alias("high"), F.min("norm").alias("low"), F.max("dims").alias("dims")).first()
    high, dims = facts["high"] or 1.0, (facts["dims"] or 0) + 1

    def band(value: Column) -> Column:
        return F.greatest(F.least(F.floor(F.log2(F.lit(high) / value)), F.lit(_BANDS - 1)).cast("int"), F.lit(0))

    rows = nodes.select("node", "embedding", band(norm).alias("band"))
    if facts["low"] and facts["low"] > high / 2:  # the usual case: one graph for all
        return rows, [0], high, dims
    return rows, sorted(r["band"] for r in rows.select("band").distinct().collect()), high, dims


def packed(nodes: DataFrame, norm: float, dims: int, guests: bool = False) -> DataFrame:
    """(node, vec): scaled, extended vectors of half-precision numbers as bytes. Guests are scaled to length 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims - 1)
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) if guests else norm)
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
            rest[rest < 1e-3] = 0  # rounding of equal norms
            made = np.hstack([x, rest]).astype(_HALF)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in made], pa.binary())], names=["node", "vec"])

    return nodes.select("node", "embedding").mapInArrow(run, "node long, vec binary")


STATE = "node long, vec binary, nbr array<bigint>, sim array<float>, fresh array<boolean>"
_STATE = ["node", "vec", "nbr", "sim", "fresh"]


def _by(rows: DataFrame, key: str, *more: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *more)


def merge(state: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The state after nodes have learnt of (node, nbr, sim): the k best neighbours, fresh if just learnt."""
    rows = state.unionByName(found, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "node"):
            node = table["node"].to_numpy()
            own = np.array(table["vec"].is_valid())
            nbr, row = _flat(table["nbr"])
            sim, _ = _flat(table["sim"])
            kept = np.flatnonzero(own)
            group = np.searchsorted(node[kept], node[row])
            learnt = ~own[row]
            order = np.lexsort((learnt, nbr, group))
            g, v = group[order], nbr[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            order = order[first]
            order = order[np.lexsort((nbr[order], -sim[order], group[order]))]
            g = group[order]
            rank = np.arange(len(g)) - np.searchsorted(g, g)
            order, g = order[rank < k], g[rank < k]
            n = len(kept)
            yield pa.RecordBatch.from_arrays([
                pa.array(node[kept]), table["vec"].take(pa.array(kept)).combine_chunks(), _lists(nbr[order], g, n, pa.int64()),
                _lists(sim[order], g, n, pa.float32()), _lists(learnt[order], g, n, pa.bool_())], names=_STATE)

    return _by(rows, "node").mapInArrow(run, STATE)


def centre(nodes: DataFrame, dims: int) -> np.ndarray:
    """The mean vector: one row per component and map task is summed in Spark."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            total += _matrix(batch.column("vec"), dims).sum(axis=0, dtype=np.float64)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], names=["at", "total", "n"])

    found = nodes.select("vec").mapInArrow(sums, "at long, total double, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = np.zeros(dims)
    for at, total, n in found.collect():
        out[at] = total / max(n, 1)
    return out


def cells(nodes: DataFrame, dims: int, count: int, trees: int, cell: int, seed: int) -> DataFrame:
    """(cell, node, vec): each node once per tree, in groups of about `cell` nodes at most."""
    bits = min(60, max(0, int(np.ceil(np.log2(max(1, count / (cell / 2)))))))
    planes = np.random.default_rng(seed).normal(size=(trees, dims, max(bits, 1)))
    mean = centre(nodes, dims)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(max(bits, 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("vec"), dims) - mean
            for tree in range(trees):
                codes = ((x @ planes[tree] > 0) @ powers if bits else np.zeros(len(x), dtype=np.int64)) * trees + tree
                yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column("node"), batch.column("vec")], names=["cell", "node", "vec"])

    coded = nodes.mapInArrow(code, "cell long, node long, vec binary")
    large = common.stored(coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell), "large")
    piece = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "node", "cell"), F.ceil(F.col("n") / cell))).otherwise(0)
    return coded.join(large, "cell", "left").select(F.xxhash64("cell", piece).alias("cell"), "node", "vec")


def first_neighbours(nodes: DataFrame, dims: int, count: int, k: int, trees: int, cell: int, seed: int) -> DataFrame:
    """(node, nbr, sim) from cells of random hyperplanes."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "cell"):
            cells, node = table["cell"].to_numpy(), table["node"].to_numpy()
            x = _matrix(table["vec"], dims)
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            for a, b in zip(starts, [*starts[1:], len(cells)]):
                for at in np.array_split(np.arange(a, b), -(-(b - a) // cell)):
                    sims = x[at] @ x[at].T
                    np.fill_diagonal(sims, -np.inf)
                    top = min(k, len(at) - 1)
                    if top < 1:
                        continue
                    best = np.argpartition(-sims, top - 1, axis=1)[:, :top]
                    row = np.repeat(np.arange(len(at)), top)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(node[at]), _lists(node[at][best.ravel()], row, len(at), pa.int64()),
                        _lists(sims[row, best.ravel()], row, len(at), pa.float32())], names=["node", "nbr", "sim"])

    return _by(cells(nodes, dims, count, trees, cell, seed), "cell", "node").mapInArrow(compare, "node long, nbr array<bigint>, sim array<float>")


def compared(state: DataFrame, dims: int, k: int, group: int, turn: int) -> DataFrame:
    """(node, nbr, sim) that members of a pivot's group learn of each other."""
    ends = state.select("node", F.explode(F.arrays_zip("nbr", "fresh")).alias("e")).select(
        "node", F.col("e.nbr").alias("nbr"), F.col("e.fresh").alias("fresh"))
    members = ends.select(F.col("node").alias("pivot"), F.col("nbr").alias("member"), "fresh").unionByName(
        ends.select(F.col("nbr").alias("pivot"), F.col("node").alias("member"), "fresh"))
    chosen = Window.partitionBy("pivot").orderBy(F.desc("fresh"), F.xxhash64(F.lit(turn), "pivot", "member"), "member")
    members = members.withColumn("place", F.row_number().over(chosen)).where(F.col("place") <= group)
    last = F.when(F.size("sim") < k, F.lit(-np.inf)).otherwise(F.element_at("sim", -1)).cast("float")
    facts = state.select(F.col("node").alias("member"), "vec", last.alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, "pivot"):
            pivots = whole["pivot"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], pivots[1:] != pivots[:-1])))
            edges = [*starts[::512].tolist(), len(pivots)]
            for a, b in zip(edges, edges[1:]):
                table = whole.slice(a, b - a)
                pivot, member = pivots[a:b], table["member"].to_numpy()
                fresh, last_sim = table["fresh"].to_numpy(), table["last"].to_numpy()
                g = np.cumsum(np.concatenate(([0], pivot[1:] != pivot[:-1])))
                place = np.arange(len(g)) - np.searchsorted(g, g)
                n, m = g[-1] + 1, place.max() + 1
                x = np.zeros((n, m, dims), dtype=np.float32)
                ids, new, need = np.full((n, m), -1, dtype=np.int64), np.zeros((n, m), bool), np.full((n, m), np.inf, dtype=np.float32)
                x[g, place], ids[g, place], new[g, place], need[g, place] = _matrix(table["vec"], dims), member, fresh, last_sim
                sims = x @ x.transpose(0, 2, 1)
                there = np.zeros((n, m), bool)
                there[g, place] = True
                good = (sims > need[:, :, None]) & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
                i, p, q = np.nonzero(good)
                node, nbr, sim = ids[i, p], ids[i, q], sims[i, p, q]
                order = np.lexsort((nbr, node))
                node, nbr, sim = node[order], nbr[order], sim[order]
                once = np.ones(len(node), dtype=bool)
                once[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
                node, nbr, sim = node[once], nbr[once], sim[once]
                order = np.lexsort((nbr, -sim, node))
                node, nbr, sim = node[order], nbr[order], sim[order]
                rank = np.arange(len(node)) - np.searchsorted(node, node)
                node, nbr, sim = node[rank < k], nbr[rank < k], sim[rank < k]
                names, at = np.unique(node, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names), _lists(nbr, at, len(names), pa.int64()), _lists(sim, at, len(names), pa.float32())], names=["node", "nbr", "sim"])

    rows = members.select("pivot", "member", "fresh").join(facts, "member")
    return _by(rows, "pivot").mapInArrow(run, "node long, nbr array<bigint>, sim array<float>")


def graph(nodes: DataFrame, dims: int, k: int = 32, trees: int = 16, cell: int = 2048, group: int = 48, rounds: int = 3,
          seed: int = 3) -> DataFrame:
    """The neighbour graph: node, vec, nbr (nearest first), sim, fresh."""
    nodes = common.stored(nodes, "nodes")
    empty = nodes.selectExpr("node", "vec", "cast(array() as array<bigint>) nbr", "cast(array() as array<float>) sim",
                             "cast(array() as array<boolean>) fresh")
    state = common.stored(merge(empty, first_neighbours(nodes, dims, nodes.count(), k, trees, cell, seed), k), "graph")
    for turn in range(rounds):
        state = common.stored(merge(state, compared(state, dims, k, group, turn), k), "graph")
    return state


BEAM = "q long, qvec binary, nbr array<bigint>, sim array<float>, opened array<boolean>, todo array<bigint>"
_BEAM = ["q", "qvec", "nbr", "sim", "opened", "todo"]


def ways(state: DataFrame, back: int) -> DataFrame:
    """(at, cands): the nodes an edge leads to from each node, its own neighbours and the `back` nearest that have it as one.

    The lists are bounded, so a node that very many others point to is one short row like any other.
    """
    edges = state.select("node", F.explode(F.arrays_zip("nbr", "sim")).alias("e")).select("node", "e.nbr", "e.sim")
    nearest_first = Window.partitionBy("nbr").orderBy(F.desc("sim"), "node")
    to = edges.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= back)
    both = state.select(F.col("node").alias("at"), F.explode("nbr").alias("cand")).unionByName(
        to.select(F.col("nbr").alias("at"), F.col("node").alias("cand")))
    return both.groupBy("at").agg(F.collect_set("cand").alias("cands"))


def search(state: DataFrame, queries: DataFrame, dims: int, beam: int = 96, opens: int = 24, hops: int = 8,
           back: int = 32) -> DataFrame:
    """(q, nbr, sim) of the beam of each query node, from (q, qvec, nbr): its vector and where it starts."""
    vectors = state.select(F.col("node").alias("cand"), "vec")
    links = common.stored(ways(state, back), "ways")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "q"):
            q = table["q"].to_numpy()
            own = np.array(table["qvec"].is_valid())
            kept = np.flatnonzero(own)
            mine = np.searchsorted(q[kept], q)
            nbr, row = _flat(table["nbr"])
            sim, _ = _flat(table["sim"])
            opened, _ = _flat(table["opened"])
            asked = np.flatnonzero(~own)
            x = _matrix(table["qvec"].take(pa.array(kept)), dims)
            new_sim = np.einsum("ij,ij->i", x[mine[asked]], _matrix(table["vec"].take(pa.array(asked)), dims)) if len(asked) else np.zeros(0, np.float32)
            ids = np.concatenate([nbr, table["cand"].take(pa.array(asked)).to_numpy()]).astype(np.int64)
            sims = np.concatenate([sim, new_sim]).astype(np.float32)
            seen = np.concatenate([opened, np.zeros(len(asked), bool)]).astype(bool)
            g = np.concatenate([mine[row], mine[asked]])
            order = np.lexsort((~seen, ids, g))
            once = np.ones(len(order), bool)
            once[1:] = (g[order][1:] != g[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[once]
            order = order[np.lexsort((ids[order], -sims[order], g[order]))]
            own_g = g[order]
            rank = np.arange(len(own_g)) - np.searchsorted(own_g, own_g)
            order, own_g = order[rank < beam], own_g[rank < beam]
            closed = ~seen[order]
            before = np.cumsum(closed) - closed
            start = np.searchsorted(own_g, np.arange(len(kept)))
            nth = before - before[np.minimum(start, max(len(before) - 1, 0))][own_g] if len(before) else before
            todo = closed & (nth < opens)
            n = len(kept)
            yield pa.RecordBatch.from_arrays([
                pa.array(q[kept]), table["qvec"].take(pa.array(kept)).combine_chunks(), _lists(ids[order], own_g, n, pa.int64()),
                _lists(sims[order], own_g, n, pa.float32()), _lists(seen[order] | todo, own_g, n, pa.bool_()),
                _lists(ids[order][todo], own_g[todo], n, pa.int64())], names=_BEAM)

    none = F.array()
    beams = queries.select("q", "qvec", none.cast("array<bigint>").alias("nbr"), none.cast("array<float>").alias("sim"),
                           none.cast("array<boolean>").alias("opened"), none.cast("array<bigint>").alias("todo"))
    wanted = queries.select("q", F.explode("nbr").alias("cand")).join(vectors, "cand").select("q", "cand", "vec")
    for _ in range(hops + 1):
        rows = beams.drop("todo").unionByName(wanted, allowMissingColumns=True)
        beams = common.stored(_by(rows, "q").mapInArrow(run, BEAM), "beams")
        todo = beams.select("q", F.explode("todo").alias("at"))
        if todo.isEmpty():
            break
        # at most opens * (degree + back) ids a query: whole lists travel, and what the beam holds is taken out before vectors join
        step = todo.join(links, "at").groupBy("q").agg(F.flatten(F.collect_list("cands")).alias("cands"))
        known = beams.select("q", F.array_append("nbr", F.col("q")).alias("known"))
        wanted = step.join(known, "q").select("q", F.explode(F.array_except("cands", "known")).alias("cand")).join(
            vectors, "cand").select("q", "cand", "vec")
    return beams.select("q", F.explode(F.arrays_zip("nbr", "sim")).alias("e")).select("q", F.col("e.nbr").alias("nbr"), F.col("e.sim").alias("sim"))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, degree: int = 32, trees: int = 16, rounds: int = 3, beam: int = 96,
            opens: int = 24, hops: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, from rows (vec_id, embedding).

    `is_query` is a condition on vec_id. Every other row is a candidate.
    """
    vectors = common.stored(usable(rows), "vectors")
    nodes = common.stored(nodes_of(vectors), "distinct")
    rows_of, bands, norm, dims = banded(nodes)
    owners = common.stored(vectors.join(nodes, "embedding").select("vec_id", "node"), "owners")
    asked = owners.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    asking = asked.select(F.col("q").alias("node")).distinct()
    found = asking.select(F.col("node").alias("q"), F.col("node").alias("nbr"))
    for band in bands:
        halves = packed(rows_of if len(bands) == 1 else rows_of.where(F.col("band") == band), norm / 2**band, dims)
        if len(bands) > 1:
            others = rows_of.where(F.col("band") != band).join(asking, "node", "left_semi")
            halves = halves.unionByName(packed(others, norm, dims, guests=True))
        state = graph(halves, dims, degree, trees, rounds=rounds)
        starts = state.join(asking, "node", "left_semi").select(F.col("node").alias("q"), F.col("vec").alias("qvec"), "nbr")
        found = found.unionByName(search(state, _plain_queries(starts, dims), dims, beam, opens, hops).select("q", "nbr"))
    found = found.distinct()
    mine = nodes.select(F.col("node").alias("q"), F.col("embedding").alias("qe"))
    theirs = nodes.select(F.col("node").alias("nbr"), F.col("embedding").alias("ne"))
    scored = found.join(mine, "q").join(theirs, "nbr").select("q", "nbr", _inner("qe", "ne").alias("score"))
    # of equal vectors a query can use its k smallest ids, and one more where its own is among them
    copies = owners.withColumn("copy", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    near = Window.partitionBy("q").orderBy(F.desc("score"), "nbr")
    best = scored.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    pairs = asked.join(best, "q").join(copies.select(F.col("node").alias("nbr"), "vec_id"), "nbr").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plain_queries(starts: DataFrame, dims: int) -> DataFrame:
    """A query's extra component is 0: its products are then those of the original vectors, scaled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("qvec").to_pylist()), dtype=_HALF).reshape(-1, dims).copy()
            x[:, -1] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), pa.array([r.tobytes() for r in x], pa.binary()), batch.column("nbr")], names=["q", "qvec", "nbr"])

    return starts.mapInArrow(run, "q long, qvec binary, nbr array<bigint>")
