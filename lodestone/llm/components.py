"""Connected components of a link table, by alternating large-star and small-star steps.

Each step groups by a pre-aggregated minimum, writes it and joins it back, so a
node with very many links is a hot key of a join of two plain shuffles, which
adaptive execution can split.  Every step's links are a table in the shared
folder; the ones before are deleted.  Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _least(links: DataFrame) -> DataFrame:
    return written(links.groupBy("a").agg(F.min("b").alias("m")), "links-least")


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's greater neighbours, linked to its least one; as a written table."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    joined = both.join(least.select("a", F.least("a", "m").alias("m")), "a").filter("b > a AND b <> m")
    out = written(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
    discard(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's lesser neighbours, linked to its least one; as a written table."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    discard(least)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Self-links and repeated links are allowed; rows with a null end are no
    links; an empty table gives an empty result.
    """
    current = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        large = _large_star(current)
        following = _small_star(large)
        discard(large)
        row = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = following
        if state == tuple(row):
            break
        state = tuple(row)
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
