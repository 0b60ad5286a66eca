"""Connected components by alternating stars, in DataFrame functions.

In a large-star step each node tells its larger neighbours the smallest node it knows; in a small-star
step its smaller ones. Both keep components, and repeated they end with every node linked to the smallest
of its component, in a number of rounds that grows with the logarithm of the longest path. Each round is
written to the shared folder, so lineage stays short.

Edge cases: loops and repeated edges are ignored, and edges with a null end; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import discard, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node of it), for every node that has an edge to another."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
