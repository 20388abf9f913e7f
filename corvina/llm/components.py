"""Connected components over an edge table, by alternating large and small stars.

Each round is two aggregations and two equi-joins; nothing is collected but one row
of counters. A hub's edges are only ever aggregated to a minimum (combined before the
shuffle) and joined back, where adaptive execution can split a skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return hung.union(low.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs from one root at most, and no root hangs from another."""
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    by = seen.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` has two columns of one type, in any direction; self-loops and repeats are
    ignored, nulls dropped. Nodes without edges don't appear. An empty table gives none.
    """
    a, b = edges.columns[:2]
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    # a is above b in every edge: each node hangs from smaller ones
    e = materialise(e.filter("a <> b").distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(e):
            break
        large = materialise(_large_star(e), "cc")
        small = materialise(_small_star(large), "cc")
        discard(e, large)  # whose rows the next table holds
        e = small
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
