"""Connected components by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over directed edges (u, v): every u hands its smallest neighbour on to the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, label) of every node with an edge, where the label is the smallest node of its component; and the stars (u, v).

    ``edges`` has long columns u and v. Ends when every node points at its label; the number of steps grows with the
    logarithm of the longest path, and each step moves at most as many rows as there are edges.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        large = scratch.write(_star(now, True))
        after = scratch.write(_star(large, False))
        scratch.drop(now, large)
        now = after
        # settled: the same edges as before (stars), seen from a count and a sum of hashes
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    labels = now.groupBy("u").agg(F.min("v").alias("label"))
    return scratch.write(labels.select(F.col("u").alias("node"), "label").union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())), now
