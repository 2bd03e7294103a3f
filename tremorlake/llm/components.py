"""Connected components over an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of each node of edges (a long, b long): root is one node of its component.

    Each round gives a node the least of itself and its neighbours, jumps once more along
    these labels and contracts the edges to labels, so chains and stars alike shrink by a
    factor; only tables of ids are shuffled, with sums per key made before the shuffle.
    """
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, old = None, []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        least = scratch.save(least)
        far = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = scratch.save(least.join(far, "root").select("node", F.col("next").alias("root")))
        label = lambda c, s=step: s.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        left = edges.join(label("a"), "a").join(label("b"), "b").where("ra <> rb")
        new = scratch.save(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = scratch.save(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            old += [roots, step]
            roots = merged
        old += [edges, least]
        edges = new
    scratch.drop(*old)
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        roots._scratch = edges._scratch
    return roots
