"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import discard, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are hung on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of every node that ends an edge.

    ``edges`` has columns ``u`` and ``v`` of one orderable type, stored. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest chain.
    An empty table gives an empty table.
    """
    current = edges.filter("u <> v").select("u", "v")
    mark, stored = _mark(current), None
    while True:
        following = store(_small_star(_large_star(current)))
        now = _mark(following)
        if stored is not None:
            discard(stored)
        current = stored = following
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
