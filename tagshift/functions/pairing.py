"""Choice of the dijet pairing of a four-jet event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import HIGGS_MASS
from tagshift.functions import fourvec as fv
from tagshift.functions.jets import PAIRINGS


@dataclass(frozen=True)
class PairingRule:
    """Opening-distance windows of the leading and subleading dijet as functions of m4j."""

    lead_window: Callable[[Column, Column], Column]
    subl_window: Callable[[Column, Column], Column]
    second_leads_on_tie: bool


def _between(dr: Column, low: Column, high: Column) -> Column:
    return (dr > low) & (dr < high)


def _light_or_narrow(m4j: Column, dr: Column, low: Column, high: Column) -> Column:
    return F.when(m4j < 1250, _between(dr, low, high)).otherwise(dr < 1.0)


SELECTION = PairingRule(
    lead_window=lambda m, dr: _between(dr, 360.0 / m - 0.5, F.greatest(650.0 / m + 0.5, F.lit(1.5))),
    subl_window=lambda m, dr: _between(dr, 235.0 / m, F.greatest(650.0 / m + 0.7, F.lit(1.5))),
    second_leads_on_tie=False,
)
MASS_PLANE = PairingRule(
    lead_window=lambda m, dr: _light_or_narrow(m, dr, 360.0 / m - 0.5, 653.0 / m + 0.977),
    subl_window=lambda m, dr: _light_or_narrow(m, dr, 235.0 / m, 875.0 / m + 0.800),
    second_leads_on_tie=True,
)


def with_pairing(df: DataFrame, rule: PairingRule, m4j: str = "m4j", jets: str = "jets") -> DataFrame:
    """Adds ``pairing`` (0, 1, 2 or null), ``mass_gap``, ``lead_m``, ``subl_m`` and ``pair_mhh``.

    Needs the columns of ``with_dijets``. Of the allowed pairings the smallest mass gap wins, then
    the earlier pairing. All five are null when no pairing is allowed. The winner is unpacked by
    ``inline_outer``: a later filter on it is evaluated on the finished columns instead of being
    pushed into, and repeating, the whole kinematics.
    """
    j, m = F.col(jets), F.col(m4j)
    df = df.select("*", *[
        (st_b >= st_a if rule.second_leads_on_tie else st_b > st_a).alias(f"_swap{a}")
        for a, b in PAIRINGS
        for st_a, st_b in [[j[int(p[0])]["pt"] + j[int(p[1])]["pt"] for p in (a, b)]]
    ])
    candidates = []
    for idx, (a, b) in enumerate(PAIRINGS):
        swap = F.col(f"_swap{a}")
        pick = lambda c, first, second: F.when(swap, F.col(c + second)).otherwise(F.col(c + first))  # noqa: B023, E731
        scaled = [fv.rescale(fv.stored(p), F.lit(HIGGS_MASS) / F.col(f"m{p}")) for p in (a, b)]
        candidates.append(F.when(
            rule.lead_window(m, pick("dR", a, b)) & rule.subl_window(m, pick("dR", b, a)),
            F.struct(
                F.abs(F.col(f"m{a}") - F.col(f"m{b}")).alias("mass_gap"),
                F.lit(idx).alias("pairing"),
                pick("m", a, b).alias("lead_m"),
                pick("m", b, a).alias("subl_m"),
                fv.mass(fv.add(*scaled)).alias("pair_mhh"),
            ),
        ))
    best = F.array(F.array_min(F.array(*candidates)))
    return df.select("*", F.inline_outer(best)).drop(*[f"_swap{a}" for a, _ in PAIRINGS])
