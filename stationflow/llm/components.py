"""Connected components of a table of links, by alternating large-star and small-star steps.

Hubs are never gathered: each step is a minimum per node (pre-aggregated before the shuffle)
joined back to the links. A hub's links may all join one minimum; once there are ``HUB_LINKS``
links, the minima are written first, so that both sides of the join are exchanges that Spark can
split. Every round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Fewer links than this are no hub for one task.
HUB_LINKS = 1 << 20


def _star(links: DataFrame, large: bool, split: bool) -> DataFrame:
    """Joins each node's neighbours to its smallest neighbour; large: the greater ones, else the smaller ones."""
    if large:
        edges = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = edges.join(cut(least) if split else least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(cut(least) if split else least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link in (a, b); a component is its smallest node."""
    links = cut(links.select("a", "b").where("a != b").distinct())
    seen, split = None, links.count() >= HUB_LINKS
    while True:
        links = cut(_star(_star(links, True, split), False, split))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b"))).distinct()
