"""Jet-array functions and the derived kinematic columns of an event."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.constants import JET_ORDER, MAX_SELECTED_ETA, MIN_JET_PT, OTHER_JET_SLOTS, Z_MASS
from tagshift.functions import fourvec as fv

PAIRS = ["01", "23", "02", "13", "03", "12"]
PAIRINGS = [("01", "23"), ("02", "13"), ("03", "12")]
TRIPLES = ["123", "023", "013", "012"]


def scalar_pt_sum(jets: Column, n: int = 4) -> Column:
    return sum((jets[i]["pt"] for i in range(1, n)), jets[0]["pt"])


def longitudinal_sum(jets: Column, n: int = 4) -> Column:
    return sum((jets[i]["pt"] * F.sinh(jets[i]["eta"]) for i in range(1, n)), jets[0]["pt"] * F.sinh(jets[0]["eta"]))


def mean_abs_eta(jets: Column, n: int = 4) -> Column:
    return sum((F.abs(jets[i]["eta"]) for i in range(1, n)), F.abs(jets[0]["eta"])) / F.lit(float(n))


def count_selected(jets: Column, min_pt: float, max_eta: float) -> Column:
    """Jets passing the transverse-momentum and rapidity cuts, for arrays of any length."""
    return F.size(F.filter(jets, lambda j: (j["pt"] > min_pt) & (F.abs(j["eta"]) < max_eta)))


def flip_eta(jets: Column) -> Column:
    return F.transform(jets, lambda j: j.withField("eta", -j["eta"]))


def flip_phi(jets: Column) -> Column:
    return F.transform(jets, lambda j: j.withField("phi", -j["phi"]))


def rotate_phi(jets: Column, angle: Column) -> Column:
    return F.transform(jets, lambda j: j.withField("phi", fv.unsigned_phi(j["phi"] + angle)))


def symmetry_copies(jets: Column, angle: Column | None = None) -> Column:
    """The four flip variants of an event; with ``angle`` all four get one common rotation first."""
    base = jets if angle is None else rotate_phi(jets, angle)
    variants = [base, flip_phi(base), flip_eta(base), flip_eta(flip_phi(base))]
    return F.array(*[F.struct(F.lit(i).alias("variant"), v.alias("jets")) for i, v in enumerate(variants)])


def seeded_angle(event_id: Column, seed: int) -> Column:
    """Rotation angle in [0, 2 pi) that depends on the event and the seed only."""
    return F.pmod(F.xxhash64(event_id, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.lit(2 * math.pi)


def padded_other_jets(others: Column, slots: int = OTHER_JET_SLOTS) -> Column:
    """Fixed-length array of the further jets; empty slots are zero with ``isSelJet`` = -1."""

    def slot(i: Column) -> Column:
        j = F.get(others, i)
        selected = (j["pt"] > MIN_JET_PT) & (F.abs(j["eta"]) < MAX_SELECTED_ETA)
        return F.struct(
            *[F.coalesce(j[c], F.lit(0.0)).alias(c) for c in ("pt", "eta", "phi", "m")],
            F.when(j.isNull(), -1).when(selected, 1).otherwise(0).alias("isSelJet"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), slot)


def violates_forward_veto(jet: Column) -> Column:
    return (F.abs(jet["eta"]) > MAX_SELECTED_ETA) & (jet["pt"] < MIN_JET_PT)


def flatten_jets(df: DataFrame, jets: str = "jets", prefix: str = "canJet", n: int = 4) -> DataFrame:
    cols = [
        F.col(jets)[i][c].alias(f"{prefix}{i}_{c}") for i in range(n) for c in ("pt", "eta", "phi", "e", "m")
    ]
    return df.select("*", *cols)


def flat_to_array(df: DataFrame, n: int = 4, out: str = "jets") -> DataFrame:
    """Jets stored as ``jetPt0, jetEta0, ...`` columns become one array of structs."""
    names = {"pt": "jetPt", "eta": "jetEta", "phi": "jetPhi", "e": "jetEnergy"}
    return df.withColumn(
        out, F.array(*[F.struct(*[F.col(f"{b}{i}").alias(a) for a, b in names.items()]) for i in range(n)])
    )


def with_vectors(df: DataFrame, jets: str = "jets", n: int = 4) -> DataFrame:
    """Adds the Cartesian components px0, py0, pz0, e0, ... of the leading jets."""
    j = F.col(jets)
    return df.select("*", *[
        c for i in range(n)
        for c in fv.columns(fv.cartesian(j[i]["pt"], j[i]["eta"], j[i]["phi"], j[i]["e"]), str(i))
    ])


def with_dijets(df: DataFrame, jets: str = "jets") -> DataFrame:
    """Adds the jet vectors, the six dijet vectors and their mass, pt and opening distance.

    Each stage is its own projection so that Catalyst evaluates a shared term once.
    """
    j = F.col(jets)
    df = with_vectors(df, jets)
    df = df.select("*", *[c for p in PAIRS for c in fv.columns(fv.add(fv.stored(p[0]), fv.stored(p[1])), p)])
    cols = []
    for p in PAIRS:
        a, b = j[int(p[0])], j[int(p[1])]
        cols += [
            fv.mass(fv.stored(p)).alias(f"m{p}"),
            fv.transverse(fv.stored(p)).alias(f"pt{p}"),
            fv.delta_r(a["eta"], a["phi"], b["eta"], b["phi"]).alias(f"dR{p}"),
        ]
    return df.select("*", *cols)


def with_quadjets(df: DataFrame) -> DataFrame:
    """Distance between the two dijets of each pairing and the mass after scaling both to the Z."""
    dirs = [x for p in PAIRS for x in (fv.eta(fv.stored(p)).alias(f"eta{p}"), fv.phi(fv.stored(p)).alias(f"phi{p}"))]
    df = df.select("*", *dirs)
    cols = []
    for a, b in PAIRINGS:
        cols.append(
            fv.delta_r(F.col(f"eta{a}"), F.col(f"phi{a}"), F.col(f"eta{b}"), F.col(f"phi{b}")).alias(f"dR{a}{b}")
        )
        scaled = [fv.rescale(fv.stored(p), F.lit(Z_MASS) / F.col(f"m{p}")) for p in (a, b)]
        cols.append(fv.mass(fv.add(*scaled)).alias(f"mZZ{a}{b}"))
    return df.select("*", *cols)


def trijet_mass(triple: str) -> Column:
    return fv.mass(fv.add(*[fv.stored(i) for i in triple]))


def four_jet_mass() -> Column:
    return fv.mass(fv.add(*[fv.stored(str(i)) for i in range(4)]))


def feature_vector(jets: str = "jets") -> Column:
    """66 numbers: 12 jet slots by (pt, eta, phi, m), 12 dijet terms, 6 quadjet terms."""
    j = F.col(jets)
    jet_part = [j[int(i)][c] for c in ("pt", "eta", "phi", "m") for i in JET_ORDER]
    dijet_part = [F.col(f"m{p}") for p in PAIRS] + [F.col(f"dR{p}") for p in PAIRS]
    quad_part = [F.col(f"dR{a}{b}") for a, b in PAIRINGS] + [F.col("m4j")] * 3
    return F.array(*[c.cast("double") for c in jet_part + dijet_part + quad_part])
