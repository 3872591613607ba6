"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). large: every node's larger neighbours go to its smallest neighbour; else its smaller ones and itself do."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root of every node of edges (u, v): root is the smallest node that it reaches.

    Each two rounds are written out, so lineage stays short, and the edges before them removed; only two numbers a round
    come to the driver. Rounds go on until the edges stay as they are, which is logarithmic in the number of nodes.
    """
    now = materialize(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), label)
    mark = None
    while True:
        stamp = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if tuple(stamp) == mark or not stamp[0]:
            break
        mark, before = tuple(stamp), now
        now = materialize(_round(_round(now, True), False), label)
        release(before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
