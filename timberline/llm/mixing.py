"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `share` of all words; a target
   stops at `most` times its source, the excess goes to the others by weight (`targets`).
2. Blocks. A source's documents stand in the order of md5(seed, id) and are cut into blocks of that order. Running sums
   over block totals give each block its place in its source's stream of words. The source's quota is the blocks, once or
   twice round, that begin before the target; the last of them counts up to the target only.
3. Tree. The quotas of a node are split between the two halves of its shards by a multivariate hypergeometric draw (source
   after source, each block a draw without replacement), down to single shards: margins stay exact on both sides.
4. Draw. The quota's blocks of a source are permuted by a hash, and each shard takes the next ones as the tree says: blocks of
   shards are disjoint, and every shard holds blocks from all over a source. What the mix takes of a document is what
   the dealt blocks hold of it; inside the shard documents are ordered by a hash.

No key is gathered in one task: a source with a third of all rows is many blocks. The tree works on counts: a node lists the
sources that it has blocks of, so a level holds at most `max_blocks` numbers, and after the first levels nodes are dealt to tasks.

Defined results: null or empty text has size 0 and is taken 0 words; equal ids tie by text hash; null source is a source
of its own, last; an empty table gives an empty mix; only the id, text, source and the columns in `carry` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import common

WEIGHTS = (5, 2, 1)
_TOP = 4  # levels of the tree in one task


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, target), one row per source, from rows (source, size).

    With r = cap / weight, sources fill up in ascending r. After the first k are full the others get
    (budget - their caps) / (weight left) per weight. That level rises with k while the next r is below it and falls
    afterwards, so the highest is the one at which nobody is above.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(one) - 1, len(weights)) + 1))
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rows = sources.withColumn("weight", cycle.cast("double")).withColumn("cap", most * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", level)
    open_ = F.col("level") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("level", F.coalesce(F.max(F.when(open_, F.col("level"))).over(whole), F.lit(0.0)))
    return rows.select("source", "n_docs", "source_size",
                       F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def _unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _source_key() -> Column:
    """Source as a key that is never null: joins stay plain equalities, and null differs from the empty string."""
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source"), F.lit("")))


def _held(counts: Column) -> Column:
    return F.filter(counts, lambda x: x["n"] > 0)


def split_tree(quotas: DataFrame, levels: int, seed: int = 7) -> DataFrame:
    """(shard, skey, blocks, first) from (skey, quota): exact quotas split over 2**levels shards; only shards with blocks.

    At a node holding n blocks, the left half takes ceil(n / 2) of them. Going through the sources, each block is drawn
    with probability (left places open) / (blocks not yet seen): the counts are multivariate hypergeometric. `first` is
    the number of blocks of the source that earlier shards take.
    """
    none = F.array().cast("array<bigint>")
    nodes = quotas.where("quota > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct(
        "skey", F.col("quota").cast("long").alias("n")))).alias("counts")).withColumn("node", F.lit(0).cast("long"))

    def deal(counts: Column, node: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        start = F.struct(total.alias("unseen"), F.ceil(total / 2).cast("long").alias("open"), none.alias("left"))

        def of_source(acc, x):
            def of_block(inner, k):
                chance = _unit(F.lit(seed), node, x["skey"], k) * inner["unseen"]
                got = F.when(chance < inner["open"], 1).otherwise(0).cast("long")
                return F.struct((inner["unseen"] - 1).alias("unseen"), (inner["open"] - got).alias("open"),
                                (inner["got"] + got).alias("got"))

            blocks = F.when(x["n"] > 0, F.sequence(F.lit(1).cast("long"), x["n"])).otherwise(none)
            dealt = F.aggregate(blocks, F.struct(
                acc["unseen"].alias("unseen"), acc["open"].alias("open"), F.lit(0).cast("long").alias("got")), of_block)
            return F.struct(dealt["unseen"].alias("unseen"), dealt["open"].alias("open"),
                            F.concat(acc["left"], F.array(dealt["got"])).alias("left"))

        return F.aggregate(counts, start, of_source, lambda acc: acc["left"])

    for level in range(levels):
        if level == _TOP:
            nodes = nodes.repartition("node")
        dealt = nodes.withColumn("left", deal(F.col("counts"), F.col("node")))
        left = F.zip_with("counts", "left", lambda c, k: F.struct(c["skey"].alias("skey"), k.alias("n")))
        right = F.zip_with("counts", "left", lambda c, k: F.struct(c["skey"].alias("skey"), (c["n"] - k).alias("n")))
        nodes = dealt.select(F.explode(F.array(
            F.struct(_held(left).alias("counts"), (F.col("node") * 2).alias("node")),
            F.struct(_held(right).alias("counts"), (F.col("node") * 2 + 1).alias("node")))).alias("half")).select("half.*")
    leaves = nodes.select(F.col("node").alias("shard"), F.inline("counts")).withColumnRenamed("n", "blocks")
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)).cast("long"))


def _in_blocks(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with their place in the order of their source and their block of it."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = rows.withColumn("order_key", F.md5(key.cast("binary"))).join(sources, "skey")
    head = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    return placed.withColumn("block", F.floor(head * F.col("n_blocks") / F.lit(2**32)).cast("long"))


def block_draws(placed: DataFrame, rounds: int) -> DataFrame:
    """(skey, block, copy, before): the blocks that a source's target needs, on each round; `before` is the words before them."""
    blocks = placed.groupBy("skey", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    earlier = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    every = blocks.withColumn("copy", F.explode(F.array(*map(F.lit, range(rounds))))).withColumn(
        "before", F.col("copy") * F.col("source_size") + F.col("before"))
    return every.where("words > 0 and before < target").select("skey", "block", "copy", "before")


def dealt_draws(draws: DataFrame, levels: int, seed: int) -> DataFrame:
    """(skey, block, copy, before, shard): each draw in the shard that the tree and the permutation give it."""
    leaves = common.stored(split_tree(draws.groupBy("skey").agg(F.count(F.lit(1)).alias("quota")), levels, seed), "tree")
    shuffled = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed), "skey", "block", "copy"), "block", "copy")
    permuted = draws.withColumn("draw", F.row_number().over(shuffled) - 1)
    slots = leaves.select("skey", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("draw"))
    return permuted.join(slots, ["skey", "draw"]).drop("draw")


def mix(docs: DataFrame, carry: tuple[str, ...] = (), share: float = 1.5, most: float = 2.0, block_docs: int = 512,
        max_blocks: int = 1 << 20, shard_blocks: int = 32, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, `carry`, size, source_size, target and draws, an array of
    (copy, shard, place) for each time the mix takes it. `place` orders the documents of a shard at random.

    A document of a dealt block is taken whole, where at least half of it lies before the target in its source's stream.
    """
    rows = docs.select("doc_id", "source", _source_key().alias("skey"), common.word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.col("text")).alias("row_hash"), *carry)
    width = F.greatest(F.lit(block_docs), F.ceil(F.sum("n_docs").over(Window.partitionBy()) / max_blocks))
    sources = common.stored(
        targets(rows.select("source", "size"), share, most)
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / width).cast("long"))
        .select(_source_key().alias("skey"), "source_size", "target", "n_blocks"), "targets")
    placed = _in_blocks(rows, sources, seed)
    draws = common.stored(block_draws(placed.drop(*carry), -int(-most // 1)), "draws")
    levels = (max(1, -(-draws.count() // shard_blocks)) - 1).bit_length()
    dealt = dealt_draws(draws, levels, seed).groupBy("skey", "block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard", "before"))).alias("dealt"))
    inside = Window.partitionBy("skey", "block").orderBy("order_key", "doc_id", "row_hash").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(dealt, ["skey", "block"], "left")
    taken = F.filter(F.coalesce("dealt", F.array().cast("array<struct<copy:int,shard:bigint,before:bigint>>")), lambda d: (
        F.col("size") > 0) & (d["before"] + F.col("within") + F.col("size") / 2 <= F.col("target")))
    made = F.transform(taken, lambda d: F.struct(
        d["copy"].alias("copy"), d["shard"].alias("shard"),
        F.xxhash64(F.lit(seed), F.col("order_key"), F.col("row_hash"), d["copy"]).alias("place")))
    return placed.select("doc_id", "source", *carry, "size", "source_size", "target", made.alias("draws"))


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row per draw, shard by shard, in random order inside a shard."""
    rows = mixed.select(*columns, F.explode("draws").alias("draw"))
    return rows.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place").select(*columns)
