"""Connected components by alternating large and small stars. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return rest.union(least.select("hi", "m")).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two edges up, or edges both up and down; otherwise the edges are stars around the smallest nodes."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("lo", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up > 0 and down > 0)").agg(F.count(F.lit(1))).first()[0] > 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of the edges (a, b) but the roots; the root is the smallest node of a component.

    Rows with a null or with equal ends are ignored. Work per round is in proportion to the edges; a node with
    most edges is only ever summed up or joined with one row.
    """
    at, to = F.col("a"), F.col("b")
    now = edges.where(at.isNotNull() & to.isNotNull() & (at != to))
    now = scratch.keep(now.select(F.greatest(at, to).alias("hi"), F.least(at, to).alias("lo")).distinct(), "edges")
    while _unfinished(now):
        before, now = now, scratch.keep(_small_star(_large_star(now)), "edges")
        scratch.drop(before)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
