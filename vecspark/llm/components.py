"""Connected components of links, by alternating star operations on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links every neighbour of a node to its least one: of larger neighbours (large star), or of smaller ones."""
    if small:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component, the least node that it reaches, for each node of links (a long, b long) that reaches a lesser one.

    The links always hold a spanning structure of what they began with; after O(log n) rounds each is (node, least).
    """
    now = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = stored(_star(_star(now, small=False), small=True), "links")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(row)
    raise RuntimeError("the links' components did not settle")
