"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round. links: u > v. Every hub is only grouped for a minimum and joined to one row, so Spark can split it."""
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (a, b): component is the smallest node that it reaches.

    Links with a null end and loops are ignored; repeated links count once; no links give no rows. Nothing but a count and a checksum
    comes to the driver; each half of a round is written to the shared folder, so that no plan holds one star for each use of it in another.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, before = staged(links.distinct(), "links"), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        links = staged(_star(staged(_star(links, True), "stars"), False), "links")
