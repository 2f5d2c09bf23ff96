"""Connected components of an edge list, with DataFrame operations only.

Alternating large-star and small-star steps: every node points its larger
neighbours (then its smaller ones) to its smallest neighbour. The edge count
never grows, a hub's edges stay separate rows (a join, not a collected group,
so adaptive execution can split a hub), and the number of rounds is
logarithmic. Each round is written to the working folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.work import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b: returns edges of the same form."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("m", "u").alias("m"))
    joined = both.join(lowest, F.col("u") == F.col("mu"))
    moved = joined.filter("v > u" if large else "v < u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    if not large:
        moved = moved.union(lowest.select(F.col("mu").alias("x"), F.col("m").alias("y")))
    return moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Return (node, root) for every node of an edge, root the smallest node reachable.

    Edges with a null end and loops say nothing and are passed over; repeated
    and reversed edges count once; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y")
    e = materialise(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if tuple(now) == mark or not now["n"]:
            break
        mark = tuple(now)
        last, e = e, materialise(_star(_star(e, True), False), "star")
        release(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()
