"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def _spread(least: DataFrame) -> DataFrame:
    """The table of least neighbours, dealt by u once more before a join.

    A join side that is an exchange of its own, and not the aggregate below it, is one that adaptive execution splits
    when the other side has very many rows of one u.
    """
    return least.withColumn("u", F.col("u").bitwiseOR(F.lit(0).cast("long")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_spread(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_spread(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre (b) or a leaf (a) of one centre, so that nothing is left to do."""
    roles = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
    of = roles.groupBy("node").agg(F.count("*").alias("n"), F.count("to").alias("n_to"), F.min("to").alias("low"), F.max("to").alias("high"))
    return of.where("n_to > 0 and (n > n_to or low < high)").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Both columns are longs; loops and repeated edges are allowed, rows with a null are ignored.  Nodes
    whose only edges are loops don't appear.  Each round ends in a table; the number of rounds grows with the
    logarithm of the longest path, and stars (each node next to the smallest alone) take none.  Nothing but one
    number a round reaches the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(now):
        now = cut(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
