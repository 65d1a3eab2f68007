"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds over distinct links: every round points each node at
the smallest node known around it, so components shrink to stars in a logarithmic number of rounds.
Each round is written to the shared folder. Aggregates are partial before their shuffle, and joins
are plain equi-joins that adaptive execution may split, so a hub node is no single task's burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links (u, v), v < u."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, root): root is the smallest node of the component; nodes without links are absent."""
    links = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = common.scratch(links, "links")
    state = None
    while True:
        before, links = links, common.scratch(_star(_star(links, True), False), "links")
        common.drop(before)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
