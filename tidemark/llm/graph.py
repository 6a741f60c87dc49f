"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stage


#: Over so many tasks the edges of one node are spread where they meet its least neighbour.
SALTS = 8


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).join(least, ["a", "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of its component.

    Each round hangs larger neighbours, then smaller ones, on the least node in reach, which halves depths. A node's
    minimum is combined before its shuffle and its edges are salted, so no node's neighbours are gathered anywhere. Rounds are written tables.
    Loops and repeated edges do no harm; an empty table gives no rows.
    """
    now = stage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_neighbour(both).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least_neighbour(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stage(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        was, mark = mark, now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
