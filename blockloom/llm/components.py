"""Connected components of a table of links by alternating large-star and small-star rounds.

A round costs a few shuffles of the links; their number falls until each node is linked to the least node of
its component alone. Rounds are written to the shared folder, so plans stay short and a lost executor costs a
reread. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are linked to the least of them. Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, with that least node. `links` has columns u and v
    of one ordered type; links from a node to itself don't count."""
    now = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(digest) == state or not digest[0]:
            return now
        state, before = tuple(digest), now
        now = saved(_small_star(_large_star(now).distinct()).distinct())
        dropped(before)
