"""Rank-based blocks of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import BLOCK_TARGETS, HALF_STEPS
from tagshift.operators.norms import scalar
from tagshift.operators.ordered import ordered_scan


def region_ranks(df: DataFrame, by: list[str], value: str = "sT") -> DataFrame:
    """0-based ``rank`` of each event by ``value`` inside its group; ties go to the smaller id."""
    return ordered_scan(df, [value, "event_id"], by=by)


def round_robin_plan(df: DataFrame, block_targets: int = BLOCK_TARGETS) -> DataFrame:
    """One row: the number of blocks, at least one, for about ``block_targets`` SR rows each."""
    n = df.agg(F.coalesce(F.count_if(F.col("region") == "SR"), F.lit(0)).alias("n_sr"))
    return n.select(F.greatest(F.lit(1), F.floor(F.col("n_sr") / block_targets)).cast("long").alias("n_blocks"))


def round_robin_blocks(df: DataFrame, block_targets: int = BLOCK_TARGETS) -> DataFrame:
    """CR and SR events dealt in sT order to blocks: (event_id, region, block, pos, ...).

    Every row is dealt. Blocks differ by at most one row of each region, so no block can be hot.
    """
    sub = df.where(F.col("region").isin("CR", "SR"))
    ranked = region_ranks(sub, ["region"]).withColumn("_n", scalar(round_robin_plan(sub, block_targets), "n_blocks"))
    return ranked.withColumn("block", F.col("rank") % F.col("_n")).withColumn("pos", F.expr("rank div _n")).drop("_n")


def step_size(n_rows: Column, steps: int = HALF_STEPS) -> Column:
    return F.greatest(F.lit(1), F.floor(n_rows / steps)).cast("long")


def half_step(rank: Column, n_rows: Column, steps: int = HALF_STEPS) -> Column:
    """Half-step number of a rank; the last step also takes the remainder."""
    return F.least(F.lit(steps - 1), F.floor(rank / step_size(n_rows, steps))).cast("long")


def half_step_blocks(df: DataFrame, steps: int = HALF_STEPS, value: str = "sT") -> DataFrame:
    """Each row of a ranked sample once per block it lies in: (event_id, rank, block, pos)."""
    n = scalar(df.agg(F.count(F.lit(1)).alias("n")), "n")
    ranked = ordered_scan(df.select("event_id", value), [value, "event_id"])
    ranked = ranked.withColumn("_size", step_size(n, steps)).withColumn("_step", half_step(F.col("rank"), n, steps))
    blocks = ranked.select(
        "event_id", "rank", "_size", F.explode(F.array(F.col("_step") - 1, F.col("_step"))).alias("block")
    )
    return blocks.where(F.col("block").between(0, steps - 2)).select(
        "event_id", "rank", "block", (F.col("rank") - F.col("block") * F.col("_size")).alias("pos")
    )
