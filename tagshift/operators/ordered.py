"""Ranks and running sums over a whole table, or over very large groups, in sort order.

A window without a partition key moves every row into one task. Here the rows are range
partitioned on the full sort key, so equal or hot leading values still spread over tasks, and only
one total per range partition is added up to get each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagshift.sources.store import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def ordered_scan(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    running: dict[str, str] | None = None,
    rank: str | None = "rank",
    following: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Adds a 0-based ``rank``, exclusive running sums and neighbours in order, restarting at each ``by`` group.

    ``order`` must be unique within a group. ``running`` maps an output column to the column that
    is summed over all earlier rows of the group, ``following`` to the one whose first value that is not null
    is taken from this row or the rows after it, ``previous`` to the one whose value in the row before is taken.
    """
    by, running, following, previous = list(by or []), dict(running or {}), dict(following or {}), dict(previous or {})
    keys = [*by, *order]
    slot = F.monotonically_increasing_id()
    # without a given number, adaptive execution merges small neighbouring ranges, still in order
    staged = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", slot), "ordered"
    )
    staged = staged.withColumn("_part", F.shiftright("_slot", _LOCAL_BITS).cast("int"))

    totals = staged.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_t_{o}") for o, c in running.items()],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_slot"))).alias(f"_f_{o}") for o, c in following.items()],
        *[F.max_by(c, "_slot").alias(f"_p_{o}") for o, c in previous.items()],
    )
    # at most one group per range partition began in an earlier partition, and one goes on in a later one, so this
    # keeps no more than two rows for each partition; the window sees one row per partition and group
    along = W.partitionBy(*by).orderBy("_part")
    before, after = along.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part", F.sum("_n").over(before).alias("_b_n"),
        *[F.sum(f"_t_{o}").over(before).alias(f"_b_{o}") for o in running],
        *[F.last(f"_f_{o}", ignorenulls=True).over(after).alias(f"_a_{o}") for o in following],
        *[F.lag(f"_p_{o}").over(along).alias(f"_l_{o}") for o in previous],
    ).where(" OR ".join(f"{c} IS NOT NULL" for c in ["_b_n", *[f"_a_{o}" for o in following]]))

    if not by and not running and not following and not previous:
        row = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        out = staged.join(F.broadcast(offsets), "_part", "left")
        return out.select(*df.columns, (row + F.coalesce("_b_n", F.lit(0))).alias(rank))

    local = W.partitionBy("_part", *by).orderBy("_slot")
    earlier = local.rowsBetween(W.unboundedPreceding, -1)
    # read backwards, as a frame that reaches to the end would be summed anew for every row
    onwards = W.partitionBy("_part", *by).orderBy(F.desc("_slot")).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = (staged.agg(F.max("_part")).first()[0] or 0) + 1
    placed = staged.repartitionById(n, F.col("_part"))
    placed = placed.select(
        "*", F.row_number().over(local).cast("long").alias("_k"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_s_{o}") for o, c in running.items()],
        *[F.last(c, ignorenulls=True).over(onwards).alias(f"_n_{o}") for o, c in following.items()],
        *[F.lag(c).over(local).alias(f"_v_{o}") for o, c in previous.items()],
    )
    out = placed.join(F.broadcast(offsets), ["_part", *by], "left")
    cols: list[Column] = [F.col(c) for c in df.columns]
    if rank:
        cols.append((F.col("_k") - 1 + F.coalesce("_b_n", F.lit(0))).alias(rank))
    cols += [(F.col(f"_s_{o}") + F.coalesce(f"_b_{o}", F.lit(0))).alias(o) for o in running]
    cols += [F.coalesce(f"_n_{o}", f"_a_{o}").alias(o) for o in following]
    cols += [F.when(F.col("_k") > 1, F.col(f"_v_{o}")).otherwise(F.col(f"_l_{o}")).alias(o) for o in previous]
    return out.select(*cols)
