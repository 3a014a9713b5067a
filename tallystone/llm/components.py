"""Connected components by alternating stars, and shared tables between their rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b of one type); label is the smallest
    node that can be reached. Loops, repeated edges and null ends do no harm.

    Each round hangs the neighbours of every node on the smallest node known around it, first
    the larger neighbours, then the smaller ones; the edges shrink to one star per component.
    Rounds grow with the logarithm of the longest path. Minima combine map-side and the rows of
    a node with many neighbours are joined, never gathered. Each round is written to the shared
    folder, so a lost executor repeats one round only."""
    up = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = stored(edges.where(F.col("a") != F.col("b")).select(*up).distinct(), "edges")
    seen = None
    while (now := stars.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
