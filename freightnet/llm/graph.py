"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightnet.scale import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or it and its smaller ones) to the least node around it."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # A join, not a window: the links of one hub may be a large part of all and are then split.
    rows = both.join(least, "a")
    if large:
        out = rows.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): every linked node with the least node it can reach.

    Alternates large and small stars until nothing changes: the number of rounds grows with the logarithm of the
    longest path. Each round is a written table, which ends its lineage.
    """
    links = cut(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    last = None
    while True:
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == last:
            break
        last = state
        links = cut(_star(_star(links, large=True), large=False))
    every = links.unionByName(links.select(F.col("b").alias("a"), "b"))
    return every.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
