"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node.

    Alternating large-star and small-star steps.  Each step takes minima with
    partial aggregation and joins them back, so a node with very many
    neighbours is never collected; every round is written to the shared folder.
    Null ends and loops are ignored, repeated edges count once.  No edges: no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    now = persist_table(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = persist_table(small.distinct(), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges and a sum over their hashes: equal when nothing changed."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFFFFF))).first()
    return row[0], row[1] or 0
