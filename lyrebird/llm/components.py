"""Connected components by alternating large-star and small-star steps, wholly as joins and aggregations.

Every step is a partial ``min`` by node and a join back, so a node with very many neighbours is combined
before the shuffle and its join partition can be split by adaptive execution. Nothing is collected but one
row with a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Large: hang the larger neighbours of u, small: the smaller ones, on the least."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else edges
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = side.where(F.col("v") > F.col("u")) if large else side
    moved = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node reachable.

    Repeated edges, edges in both directions and self edges change nothing; edges with a null end are
    ignored; no edges give no rows.
    """
    e = settle(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if not mark["n"] or (mark["n"], mark["x"]) == seen:
            break
        seen = (mark["n"], mark["x"])
        e = settle(_star(_star(e, True), False))
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
