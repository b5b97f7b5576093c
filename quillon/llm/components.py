"""Connected components of a table of links, by joins and aggregations only.

Each round hooks every node onto the least node in its neighbourhood (large star, then small star), so
that the number of rounds grows with the logarithm of a component's length. Nodes are longs or strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

ROUNDS = 60


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours of a node take its least neighbour. Small star: smaller ones do. The
    table of links is written and replaced."""
    if small:
        pairs = links.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    else:
        pairs = links.select(F.col("a").alias("n"), F.col("b").alias("m")).union(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
    # Written, so that both sides of the join are plain shuffles: Spark splits a star's centre.
    least = materialize(pairs.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low")))
    joined = pairs.hint("merge").join(least.hint("merge"), "n")
    if small:
        out = joined.select(F.col("m").alias("a"), F.col("low").alias("b")).union(least.select(F.col("n").alias("a"), F.col("low").alias("b")))
    else:
        out = joined.filter(F.col("m") > F.col("n")).select(F.col("m").alias("a"), F.col("low").alias("b"))
    found = materialize(out.filter(F.col("a") != F.col("b")).distinct())
    discard(least, links)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that links (columns a, b) name; root is the least node reachable."""
    links = materialize(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        links = _star(_star(links, False), True)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
