"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b); nodes are longs whose order is random, such as hashes.

    Each round every node takes the least of its neighbours and itself as its label, and the links are rewritten to
    labels; a component of links stays connected, another never joins it, and with random order the nodes shrink by a
    constant share. Each round is written to the shared folder; links between one pair are folded, so a hub costs its
    distinct neighbours, and joins on a hub are plain joins that Spark splits by size.
    """
    edges = common.stored(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        labels = common.stored(ends.groupBy(F.col("e.a").alias("node")).agg(
            F.least(F.min("e.b"), F.col("node")).alias("label")), "labels")
        if roots is None:
            roots = labels.select("node", F.col("label").alias("root"))
        else:
            step = labels.select(F.col("node").alias("root"), "label")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("label", "root").alias("root"))
        roots = common.stored(roots, "roots")
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = common.stored(edges.join(a, "a").join(b, "b").where("la <> lb").select(
            F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return roots
