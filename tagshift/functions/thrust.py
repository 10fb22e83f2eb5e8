"""Transverse thrust of a four-jet event.

The thrust axis is parallel to one of the signed sums of the transverse momenta, so eight sign
patterns (the first sign can be fixed) give the exact maximum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def thrust(jets: Column) -> Column:
    """STRUCT<value, phi>: largest sum of |projections| and the axis direction."""
    px = [jets[i]["pt"] * F.cos(jets[i]["phi"]) for i in range(4)]
    py = [jets[i]["pt"] * F.sin(jets[i]["phi"]) for i in range(4)]
    sums = []
    for pattern in range(8):
        sx, sy = px[0], py[0]
        for k in range(3):
            plus = (pattern >> k) & 1 == 0
            sx = sx + px[k + 1] if plus else sx - px[k + 1]
            sy = sy + py[k + 1] if plus else sy - py[k + 1]
        sums.append(F.struct(F.sqrt(sx * sx + sy * sy).alias("value"), F.atan2(sy, sx).alias("phi")))
    return F.greatest(*sums)


def thrust_scan(jets: Column, steps: int) -> Column:
    """Largest sum of |projections| over a regular grid of directions in [0, 2 pi]."""

    def projected(k: Column) -> Column:
        angle = k * F.lit(2 * math.pi / (steps - 1))
        terms = [jets[i]["pt"] * F.abs(F.cos(jets[i]["phi"] - angle)) for i in range(4)]
        return terms[0] + terms[1] + terms[2] + terms[3]

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), projected))
