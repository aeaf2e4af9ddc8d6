"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: every neighbour of a node is tied to the node's least neighbour.

    Both directions count in a large step, only smaller neighbours in a small
    one. Nodes are grouped by a partial minimum and joined back, so the
    neighbours of a hub are never gathered in one place.
    """
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")) if small else tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node at most, and to none that is tied itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), as a written table: component is the least node reachable. No edges give no rows."""
    e = edges.where("a != b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    e = materialise(e, "edges")
    while not _settled(e):
        nxt = materialise(_star(_star(e, small=False), small=True), "edges")
        discard(e)
        e = nxt
    found = materialise(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    discard(e)
    return found
