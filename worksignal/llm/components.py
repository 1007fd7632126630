"""Connected components of a graph held as a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksignal.session import release, settle


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour, then each node with its smaller ones."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # `large` holds (node, smaller neighbour) only, as m <= a < b.
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): the component is its least node.

    Each round is a table in the shared folder, so lost executors cost one round at most; the
    driver sees a count and a checksum. Rounds grow with the logarithm of the longest path. Loops,
    repeated edges and edges in both directions are allowed, NULL ends are left out.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, seen = settle(edges), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        state = settle(_stars(state))
        release(state.sparkSession)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
