"""Connected components by alternating large and small stars, all as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, kept


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the least node around ``u``, and the table of these; it is written first, so that AQE can split a hub's join."""
    least = kept(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return edges.join(least, "u"), least


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Return ``(node, root)`` for every node of ``edges(u, v)``: root is the least node reachable.

    Each round hooks larger neighbours to the least neighbour (large star), then smaller ones
    (small star).  Every step is an aggregation with map-side combine and an equi-join, and is
    written to the shared folder, so hub nodes are split by AQE and lost executors cost one round;
    what a round has read is deleted when its own result is written.
    Self-loops and repeated edges are allowed; an empty edge table gives an empty result.
    """
    now = kept(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, least = _star(both)
        large = kept(starred.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(now, least)
        starred, least = _star(large)
        small = (
            starred.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(starred.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        now = kept(small, "edges")
        discard(large, least)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
