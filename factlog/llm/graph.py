"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, spread_join, stored


def _beside(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    return edges.join(F.broadcast(least), "u") if small else spread_join(edges, least, "u")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour. edges: u > v; small: they may be sent to every task. Links may repeat."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    tied = _beside(both.filter("v > u"), least, small).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied if small else tied.distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = _beside(edges, least, small).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", "m")).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes with more than one link upwards, or linked to a linked one: none in a forest of stars. edges: u > v, distinct."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").select("k")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. edges: two columns of longs; no order, repeats or loops matter.

    Each round is written to the shared folder, so that lineage stays short and lost executors cost one round. A star
    around a very large group costs a row for each member, dealt out over many tasks: no pairs within groups are made.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, "links")
    small = few(now)  # links never get more
    while True:
        after = stored(_small_star(_large_star(now, small), small), "links")
        if _unfinished(after).isEmpty():
            break
        now = after
    ends = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stored(after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends), "components")
