"""Four-vector algebra as Column expressions.

A vector is a Python tuple of four scalar columns, stored flat (``px01, py01, pz01, e01``). Struct
columns would repeat the whole struct at every field access when a filter is pushed down.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    px: Column
    py: Column
    pz: Column
    e: Column


def stored(name: str) -> Vec:
    """The vector stored in the columns px<name>, py<name>, pz<name> and e<name>."""
    return Vec(*[F.col(f"{c}{name}") for c in Vec._fields])


def columns(v: Vec, name: str) -> list[Column]:
    return [x.alias(f"{c}{name}") for c, x in zip(Vec._fields, v)]


def energy_from_mass(pt: Column, eta: Column, m: Column) -> Column:
    return F.sqrt(pt * pt * F.cosh(eta) * F.cosh(eta) + m * m)


def cartesian(pt: Column, eta: Column, phi: Column, e: Column) -> Vec:
    return Vec(pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta), e)


def add(*vectors: Vec) -> Vec:
    return Vec(*[reduce(lambda a, b: a + b, parts) for parts in zip(*vectors)])


def rescale(vector: Vec, factor: Column) -> Vec:
    return Vec(*[x * factor for x in vector])


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def mass(v: Vec) -> Column:
    """Invariant mass; space-like vectors get a negative mass."""
    return signed_sqrt(v.e * v.e - v.px * v.px - v.py * v.py - v.pz * v.pz)


def transverse(v: Vec) -> Column:
    return F.sqrt(v.px * v.px + v.py * v.py)


def eta(v: Vec) -> Column:
    return F.asinh(v.pz / transverse(v))


def phi(v: Vec) -> Column:
    return F.atan2(v.py, v.px)


def wrap_phi(dphi: Column) -> Column:
    """Angle difference brought to [-pi, pi)."""
    return F.pmod(dphi + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def unsigned_phi(angle: Column) -> Column:
    """Angle brought to [0, 2 pi)."""
    return F.pmod(angle, F.lit(2 * math.pi))


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    dphi = wrap_phi(phi1 - phi2)
    return F.sqrt((eta1 - eta2) * (eta1 - eta2) + dphi * dphi)
