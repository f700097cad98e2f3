"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b): the smallest node reachable.

    Every step is a minimum per node and an equi-join, written to the shared folder; a node with very many edges is
    pre-aggregated and its join split by adaptive execution. Edges never reach the driver; it only learns whether all of
    them are stars by now, each with its smallest node in the middle.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = saved(e, "edges")
    while not _stars(e):
        # large star: larger neighbours hang on the smallest of a node's neighbourhood
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        e = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = saved(e, "large-star")
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        down = e.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        e = saved(down.select("x.a", "x.b").filter("a <> b").distinct(), "small-star")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b) has one edge down and none hangs on it, or only hangs others."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                                      F.struct(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x")).select("x.*")
    n = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)")
    return not n.limit(1).count()
