"""Connected components of a table of links, by alternating large and small stars.

No node's links are gathered in one task: each step is a minimum per node (combined before the
shuffle) and a join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b) with a > b. Each node's neighbours get linked to the least of them;
    a large star moves the larger neighbours only, a small star the smaller ones and the node."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select("v", "m")
    else:
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        below = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        moved = below.join(least, "u").select("v", "m").union(least.select("u", "m"))
    return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without links are left out.
    links has columns a and b of one ordered type, in any direction, repeated or not."""
    now = store.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    digest = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = now.agg(*digest).first()
    while True:
        then = store.save(_stars(_stars(now, large=True), large=False), "stars")
        store.drop(now)
        now, before = then, seen
        seen = now.agg(*digest).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
