"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the smallest node
    of its neighbourhood. Small star: so do the node and its smaller ones."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("near"))
    if large:
        both = both.union(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
    least = both.groupBy("node").agg(F.min("near").alias("low"))
    least = least.select("node", F.least("node", "low").alias("low"))
    if large:
        moved = both.filter("near > node").join(least, "node").select(F.col("near").alias("u"), F.col("low").alias("v"))
    else:  # edges point from the larger node u to the smaller v
        moved = (both.join(least, "node").select(F.col("near").alias("u"), F.col("low").alias("v"))
                 .union(least.select(F.col("node").alias("u"), F.col("low").alias("v"))))
    return moved.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): the smallest node of
    its component. A hub's edges are counted down by partial minima and split
    by the skew join; no neighbourhood is gathered. Each round is written, and
    the rounds, logarithmic in the size of the largest component, end when a
    round changes nothing."""
    edges = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.write(edges, "star0")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state, turn = digest(edges), 0
    while state[0]:
        turn += 1
        edges = scratch.write(_star(_star(edges, large=True), large=False), f"star{turn}")
        scratch.drop(f"star{turn - 1}")
        last, state = state, digest(edges)
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
