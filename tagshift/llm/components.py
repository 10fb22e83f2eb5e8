"""Connected components of a table of links, by large and small stars.

Both star steps give each node its smallest neighbour and hang its other neighbours there; they
alternate until nothing changes. The smallest neighbour comes from a sum that combines before the
shuffle, and links meet it by a join with one row for each node on one side, which Spark can split
for a hot node. Each round is written to the shared folder, so a lost executor costs no lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagshift.sources.store import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u, v) with v < u. Large: each node's larger neighbours; small: its smaller ones and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))
    hung = both.join(least, "u")
    if large:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    moved = moved.where("u != v")
    return moved if large else moved.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the component's smallest node."""
    now = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        now = materialize(_star(materialize(_star(now, True), "star"), False), "star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
