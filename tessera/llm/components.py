"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, first_row


def _signature(edges: DataFrame) -> tuple:
    return tuple(first_row(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: for each node of the edges (u, v) the smallest node that it is connected with.

    Each round links every node to the smallest one it knows (large star, then
    small star), so chains shrink fast.  A round is two aggregations, each joined
    back to the edges; hot nodes are summed up before the shuffle and their rows can
    be split in the join.  Rounds are cut by checkpoints in the shared folder.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
