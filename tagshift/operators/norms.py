"""Weight sums by tag and region, and the rescalings built on them.

A sum that has to reach every row is a scalar subquery: one aggregated value, never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import SIGNAL_FRACTION


def scalar(one_row: DataFrame, column: str) -> Column:
    return one_row.select(column).scalar()


def tag_region_sums(df: DataFrame, weight: str = "weight") -> DataFrame:
    return df.groupBy("tag", "region").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("sumw"))


def transfer_norms(df: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: w3b_CR, w3b_SR, w4b_CR and pi = w4b_CR / w3b_CR (null when either is missing)."""
    pick = lambda t, r: F.sum(F.when((F.col("tag") == t) & (F.col("region") == r), F.col(weight)))
    sums = df.where(F.col("region").isin("CR", "SR")).agg(
        pick("3b", "CR").alias("w3b_CR"), pick("3b", "SR").alias("w3b_SR"), pick("4b", "CR").alias("w4b_CR")
    )
    return sums.withColumn("pi", F.when(F.col("w3b_CR") != 0, F.col("w4b_CR") / F.col("w3b_CR")))


def totals_rollup(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Counts and weight sums per tag and region, per tag, and over all rows."""
    return df.rollup("tag", "region").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("sumw"))


def training_weights(df: DataFrame, region: str = "CR") -> DataFrame:
    """4b rows get weight 1, 3b rows are scaled to the number of 4b rows of the region."""
    sub = df.where(F.col("region") == region)
    sums = sub.agg(
        F.sum(F.when(F.col("tag") == "4b", 1.0)).alias("n4b"),
        F.sum(F.when(F.col("tag") == "3b", F.col("weight"))).alias("w3b"),
    )
    factor = F.try_divide(scalar(sums, "n4b"), scalar(sums, "w3b"))
    return sub.withColumn("train_weight", F.when(F.col("tag") == "4b", 1.0).otherwise(F.col("weight") * factor))


def signal_to_background(signal: DataFrame, background: DataFrame, by_class: str | None = None) -> DataFrame:
    """Signal weights scaled to the background sum, as a whole or for each signal class.

    The class table is broadcast when it is small, as it is for a handful of classes.
    """
    target = background.agg(F.sum("weight").alias("w"))
    if by_class is None:
        own = signal.agg(F.sum("weight").alias("w"))
        return signal.withColumn("scaled", F.try_divide(F.col("weight") * scalar(target, "w"), scalar(own, "w")))
    own = signal.groupBy(by_class).agg(F.sum("weight").alias("_own"))
    return signal.join(own, by_class).withColumn(
        "scaled", F.try_divide(F.col("weight") * scalar(target, "w"), F.col("_own"))
    ).drop("_own")


def signal_to_four_tag(signal: DataFrame, four_tag: DataFrame) -> DataFrame:
    """Signal weights scaled, region by region, to the expected fraction of the 4b sum.

    Rows outside the three regions keep their weight.
    """
    regions = list(SIGNAL_FRACTION)
    fractions = F.create_map(*[x for r in regions for x in (F.lit(r), F.lit(SIGNAL_FRACTION[r]))])
    own = signal.where(F.col("region").isin(regions)).groupBy("region").agg(F.sum("weight").alias("_sig"))
    ref = four_tag.groupBy("region").agg(F.sum("weight").alias("_ref"))
    factors = own.join(ref, "region").select(
        "region", F.try_divide(F.col("_ref") * fractions[F.col("region")], F.col("_sig")).alias("_f")
    )
    # at most one row per region: three rows
    return signal.join(F.broadcast(factors), "region", "left").withColumn(
        "scaled", F.col("weight") * F.coalesce("_f", F.lit(1.0))
    ).drop("_f")


def global_rescale(df: DataFrame, total: float) -> DataFrame:
    return df.withColumn(
        "scaled", F.col("weight") * F.lit(float(total)) / scalar(df.agg(F.count(F.lit(1)).alias("n")), "n")
    )
