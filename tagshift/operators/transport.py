"""Couplings between the source and target events of a block, and moving weights through them.

A coupling is a long table (block, src_id, tgt_id, value); only its non-zero cells exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import BASE_RADIUS
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

#: weights are coupled as whole numbers, so that break points compare exactly: of a unit of this many digits below the
#: smallest positive weight of their side, or of as many as let the side's total stay below ten to the power LARGEST
DIGITS, LARGEST = 9, 18


def _mass(rows: DataFrame) -> DataFrame:
    """Rows of positive weight with it as a whole number ``m``, at least 1; negative weights are refused."""
    checked = F.when(F.col("w") < 0, F.raise_error("a coupling needs weights that are not negative").cast("double")).otherwise(F.col("w"))
    held = rows.withColumn("w", checked).where(F.col("w") > 0)
    # one row for each side
    unit = held.groupBy("role").agg(
        F.least(DIGITS - F.floor(F.log10(F.min("w"))), LARGEST - F.ceil(F.log10(F.sum("w")))).cast("double").alias("digits")
    )
    m = F.greatest(F.lit(1), F.round(F.col("w") * F.pow(F.lit(10.0), F.col("digits"))).cast("long"))
    return held.join(F.broadcast(unit), "role").select("block", "role", "x", "id", m.alias("m"))


def _wide(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)")


def monotone_coupling(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact optimal coupling per block for the cost |delta x|; inputs are (block, id, x, w).

    In one dimension mass moves in sort order: the two sets of cumulative weights are merged into
    one sequence of break points, and the stretch before a break point couples the source and the
    target whose own cumulative weight is next. No pair of events is formed that gets no mass.

    Both orders are ordered scans, so a block of any size is spread over range partitions, and a
    break point reads its neighbours in the second scan instead of looking them up.
    """
    side = lambda df, role: df.select("block", F.lit(role).alias("role"), "x", "id", F.col("w").cast("double").alias("w"))
    rows = _mass(materialize(side(sources, 0).unionByName(side(targets, 1)), "sides"))
    totals = rows.groupBy("block").agg(
        *[F.sum(F.when(F.col("role") == role, F.col("m")).otherwise(0)).alias(name) for role, name in enumerate(("all_src", "all_tgt"))]
    ).where("all_src > 0 AND all_tgt > 0")
    # cumulative weight times the other side's total: whole numbers on one common scale
    points = ordered_scan(rows, ["x", "id"], by=["block", "role"], running={"before": "m"}, rank=None).join(totals, "block").select(
        "block", "role", "id", (_wide("all_src") * _wide("all_tgt")).cast("double").alias("scale"),
        ((F.col("before") + F.col("m")).cast("decimal(19,0)") * F.when(F.col("role") == 0, _wide("all_tgt")).otherwise(_wide("all_src"))).alias("hi"),
        *[F.when(F.col("role") == role, F.col("id")).alias(name) for role, name in enumerate(("src", "tgt"))],
    )
    merged = ordered_scan(
        points, ["hi", "role", "id"], by=["block"], rank=None, following={"src_id": "src", "tgt_id": "tgt"}, previous={"lo": "hi"}
    )
    value = (F.col("hi") - F.coalesce("lo", F.lit(0))).cast("double") / F.col("scale")
    cells = merged.select("block", "src_id", "tgt_id", value.alias("value"))
    return cells.where("src_id IS NOT NULL AND tgt_id IS NOT NULL AND value > 0")


def monotone_coupling_whole(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``monotone_coupling`` of all rows as one block; inputs are (id, x, w)."""
    whole = lambda df: df.withColumn("block", F.lit(0).cast("long"))
    return monotone_coupling(whole(sources), whole(targets))


def given_source(coupling: DataFrame) -> DataFrame:
    """Adds ``conditional``: the share of a source's mass that goes to each target."""
    total = coupling.groupBy("block", "src_id").agg(F.sum("value").alias("_mass"))
    return coupling.join(total, ["block", "src_id"]).withColumn("conditional", F.try_divide("value", "_mass")).drop("_mass")


def push(coupling: DataFrame, weights: DataFrame, value: str = "value", out: str = "pushed") -> DataFrame:
    """Sum over sources of coupling times source weight: (tgt_id, pushed)."""
    joined = coupling.join(weights.select(F.col("id").alias("src_id"), F.col("w").alias("_w")), "src_id")
    return joined.groupBy("tgt_id").agg(F.sum(F.col(value) * F.col("_w")).alias(out))


def marginals(coupling: DataFrame, side: str) -> DataFrame:
    return coupling.groupBy("block", side).agg(F.sum("value").alias("mass"))


def radius_change(distance, gap, radius: float, base: float = BASE_RADIUS):
    """Event distance at another radius, from the distance at ``base`` and the plain |delta sT|."""
    return distance * F.lit(base / radius) + gap * F.lit((radius - base) / radius)
