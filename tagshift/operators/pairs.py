"""Sums over all source-target pairs of a block, without forming a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagshift.operators.ordered import ordered_scan


def gap_moments(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Per block of (block, id, x): number of pairs, mean |delta x| and mean squared delta x.

    In sort order every value only needs the number and the sum of the other side's values below
    it, so two running sums replace the product of the two sides.
    """
    both = sources.select("block", "id", "x", F.lit(0).alias("side")).unionByName(
        targets.select("block", "id", "x", F.lit(1).alias("side"))
    )
    own = lambda s, v: F.when(F.col("side") == s, v).otherwise(0.0)
    both = both.select(
        "*", own(0, F.lit(1.0)).alias("n0"), own(0, F.col("x")).alias("x0"), own(1, F.lit(1.0)).alias("n1"), own(1, F.col("x")).alias("x1")
    )
    scan = ordered_scan(
        both, ["x", "side", "id"], by=["block"], running={"bn0": "n0", "bx0": "x0", "bn1": "n1", "bx1": "x1"}, rank=None
    )
    below = F.when(F.col("side") == 0, F.col("x") * F.col("bn1") - F.col("bx1")).otherwise(F.col("x") * F.col("bn0") - F.col("bx0"))
    s = scan.groupBy("block").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"),
        F.sum(F.col("x0") * F.col("x0")).alias("q0"), F.sum(F.col("x1") * F.col("x1")).alias("q1"), F.sum(below).alias("gaps"),
    )
    pairs = F.col("n0") * F.col("n1")
    squares = F.col("n1") * F.col("q0") + F.col("n0") * F.col("q1") - 2 * F.col("x0") * F.col("x1")
    return s.select("block", pairs.cast("long").alias("n_pairs"), (F.col("gaps") / pairs).alias("mean_gap"), (squares / pairs).alias("mean_square"))


def pooled_spread(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Per block the sample standard deviation of x over sources and targets together."""
    return sources.select("block", "x").unionByName(targets.select("block", "x")).groupBy("block").agg(
        F.stddev_samp("x").alias("spread")
    )
