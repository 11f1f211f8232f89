"""Connected components of an edge table, by alternating stars.

Each round hangs the neighbours of a node on the smallest of them: first the larger ones (large star), then the others
(small star). Edges become stars around the smallest member in a logarithmic number of rounds. A node's neighbours are
never gathered: the minimum is aggregated, with a partial sum before the shuffle, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import forget, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of a type with an order. Returns a (each node but the smallest of its component) and b, that smallest.

    Loops and rows with nulls don't link; repeated and reversed edges count once; no edges give no rows."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "edges"), None
    while True:
        size = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if size == before or not size[0]:
            return now
        before, last = size, now
        now = written(_small(_large(last)), "edges")
        forget(last.sparkSession, last)
