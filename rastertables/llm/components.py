"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(links: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("u", "low").alias("low"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node in ``links`` (a, b).

    Large-star and small-star steps (each a grouped minimum and a join) repeat
    until the links stop changing: a number of rounds logarithmic in the size of
    a component.  Links stay in tables; each round's are written to the shared
    folder, and only their count and checksum reach the driver.
    """
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        # Large star: every greater neighbour is linked to the least one.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # Small star: the node and its lesser neighbours are linked to the least one.
        low = _least(large)
        moved = large.join(low, F.col("u") == F.col("n"))
        small = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").unionByName(low.select(F.col("n").alias("u"), F.col("low").alias("v"))).distinct()
        links = stored(small, "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
