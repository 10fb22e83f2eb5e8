"""Proofs that event distances are the least ones, checked by column expressions alone.

A flow that keeps to both events' pt shows that the distance can be had. Prices of the places whose sums never exceed the
cost of moving between them show that nothing is cheaper, in any orientation that was tried. Where both give the same
number, it is the minimum, whoever computed it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import BASE_RADIUS
from tagshift.functions.fourvec import wrap_phi
from tagshift.operators.emd import event_distance, variants

TOLERANCE = 1e-6  # of pt, in its unit
_SPOTS = [(i, j) for i in range(4) for j in range(4)]


def _orientation(kind: str, number: Column, steps: int) -> tuple[Column, Column, Column]:
    """Sign of eta, sign of phi and turn of the first event in orientation ``number``."""
    if kind != "thrust":
        tried = variants(kind, steps)
        pick = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), number)
        return pick([-1 if e else 1 for e, _, _ in tried]), pick([-1 if p else 1 for _, p, _ in tried]), pick([t for _, _, t in tried])
    side = F.when(F.col("src_pz") * F.col("tgt_pz") < 0, -1.0).otherwise(1.0)
    flip = F.when(number >= 2, -1.0).otherwise(1.0)
    return side, flip, -(flip * F.col("src_axis") - F.col("tgt_axis") + (number % 2) * math.pi)


def _with_costs(df: DataFrame, kind: str, number: Column, radius: float, steps: int) -> DataFrame:
    """Adds ``c_ij``, the cost of moving a unit from jet i of the source to jet j of the target."""
    eta_sign, phi_sign, turn = _orientation(kind, number, steps)
    df = df.select("*", eta_sign.alias("_e"), phi_sign.alias("_p"), turn.alias("_t"))
    at = lambda side, k, i: F.col(f"{side}_packed")[4 * k + i]
    apart = [
        (F.col("_e") * at("src", 1, i) - at("tgt", 1, j), wrap_phi(F.col("_p") * at("src", 2, i) + F.col("_t") - at("tgt", 2, j))) for i, j in _SPOTS
    ]
    return df.select("*", *[(F.sqrt(e * e + p * p) / radius).alias(f"c_{i}{j}") for (i, j), (e, p) in zip(_SPOTS, apart)]).drop("_e", "_p", "_t")


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def proven(pairs: DataFrame, kind: str, radius: float = BASE_RADIUS, steps: int = 15) -> DataFrame:
    """(tgt_id, src_id, distance, moved, flow_holds, nothing_cheaper) of pairs as ``event_distance`` takes them.

    ``moved`` is the pt that changes places. ``flow_holds``: the flow is one, moves all it can and costs the distance in the
    reported orientation. ``nothing_cheaper``: in every orientation the prices keep below the costs and add up to the distance or more.
    """
    out = event_distance(pairs, kind, radius, steps, proof=True)
    pt = lambda side, i: F.col(f"{side}_packed")[i]
    out = out.select("*", *[_sum([pt(s, i) for i in range(4)]).alias(f"{s}_sum") for s in ("src", "tgt")])
    flow = lambda i, j: F.col("flow")[4 * i + j]
    rows, columns = ([_sum([flow(*(i, j)[:: 1 if by_row else -1]) for j in range(4)]) for i in range(4)] for by_row in (True, False))
    moved = _sum([flow(i, j) for i, j in _SPOTS])
    given = _with_costs(out, kind, F.col("orientation").cast("int"), radius, steps)
    price = _sum([flow(i, j) * F.col(f"c_{i}{j}") for i, j in _SPOTS]) + F.abs(F.col("src_sum") - F.col("tgt_sum"))
    holds = (
        F.forall("flow", lambda x: x >= -TOLERANCE) & (F.abs(moved - F.least("src_sum", "tgt_sum")) <= TOLERANCE) & (F.abs(price - F.col("distance")) <= TOLERANCE)
    )
    for i in range(4):
        holds = holds & (rows[i] <= pt("src", i) + TOLERANCE) & (columns[i] <= pt("tgt", i) + TOLERANCE)
    # the kernel's rows are read once: what the flow proves goes along with the prices
    found = ["_pair", "tgt_id", "src_id", "distance", "moved", "flow_holds"]
    primal = given.select("*", F.monotonically_increasing_id().alias("_pair"), moved.alias("moved"), holds.alias("flow_holds"))
    tried = primal.select(
        *found, "src_packed", "tgt_packed", "src_sum", "tgt_sum", *[c for c in ("src_axis", "tgt_axis", "src_pz", "tgt_pz") if c in out.columns],
        F.posexplode("prices").alias("number", "y"),
    )
    tried = _with_costs(tried, kind, F.col("number"), radius, steps)
    y = F.col("y")
    below = (y[4] + y[9]) <= TOLERANCE
    for i in range(4):
        below = below & (y[i] + y[9] <= 1 + TOLERANCE) & (y[4] + y[5 + i] <= 1 + TOLERANCE)
    for i, j in _SPOTS:
        below = below & (y[i] + y[5 + j] <= F.col(f"c_{i}{j}") + TOLERANCE)
    more = F.col("src_sum") - F.col("tgt_sum")
    worth = _sum([pt("src", i) * y[i] + pt("tgt", i) * y[5 + i] for i in range(4)]) + F.greatest(-more, F.lit(0.0)) * y[4] + F.greatest(more, F.lit(0.0)) * y[9]
    judged = tried.select(*found, (below & (worth >= F.col("distance") - TOLERANCE)).alias("_holds"))
    return judged.groupBy(*found).agg(F.bool_and("_holds").alias("nothing_cheaper")).drop("_pair").where("tgt_id IS NOT NULL AND src_id IS NOT NULL")
