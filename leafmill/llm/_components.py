"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._store import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every end of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is a
    partially aggregated minimum and an equi-join, so a hub's rows can be
    split by the planner, and rounds grow with the logarithm of the longest
    path.  They end when no edge leads to a node that has an edge down itself: all are stars then.  Nothing is gathered on
    the driver, and each round's table goes when the next is written.  An empty edge list gives no rows; self-edges and repeated
    edges are allowed.
    """
    kind = edges.schema["a"].dataType
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").cast(kind).alias("b")).where("a <> b").distinct())
    while True:
        ends = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if ends.union(twice).isEmpty():
            break
        before, edges = edges, stored(_small_star(_large_star(edges)))
        discard(before)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
