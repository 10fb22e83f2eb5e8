"""Four-vector quantities of single events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import PAIRINGS, PAIRS, B, R, big, mass_of, query, r, sql, unsigned
from tagshift.functions import fourvec as fv
from tagshift.functions import jets as J
from tagshift.functions import scores as S
from tagshift.functions.pairing import MASS_PLANE, SELECTION, with_pairing
from tagshift.functions.thrust import thrust, thrust_scan
from tagshift.sources import fixtures as fx


def _cols(names, view: str, digits: int = 3) -> str:
    return sql(view, f"SELECT {B('event_id')} AS event_id, " + ", ".join(f"{R(x, digits)} AS {n}" for n, x in names.items()) + f" FROM {view}")


def _same(names) -> dict[str, str]:
    return {n: n for n in names}


@query("c01_cartesian", _cols(_same([f"{c}{i}" for i in range(4) for c in ("px", "py", "pz", "e")]), "vec"))
def cartesian(spark, d):
    v = J.with_vectors(fx.jet_events(spark, d))
    return v.select("event_id", *[
        r(f"{c}{i}", 3).alias(f"{c}{i}") for i in range(4) for c in ("px", "py", "pz", "e")
    ])


@query("c02_energy_from_mass", _cols(_same([f"e{i}" for i in range(4)]), "vec", 4))
def energy_from_mass(spark, d):
    j = F.col("jets")
    return fx.jet_events(spark, d).select("event_id", *[
        r(fv.energy_from_mass(j[i]["pt"], j[i]["eta"], j[i]["m"]), 4).alias(f"e{i}") for i in range(4)
    ])


@query("c03_jet_mass", _cols({f"m{i}": mass_of(str(i)) for i in range(4)}, "vec"))
def jet_mass(spark, d):
    v = J.with_vectors(fx.jet_events(spark, d))
    return v.select("event_id", *[r(fv.mass(fv.stored(str(i))), 3).alias(f"m{i}") for i in range(4)])


@query("c04_dijet_mass", _cols(_same([f"m{p}" for p in PAIRS]), "dij"))
def dijet_mass(spark, d):
    v = J.with_dijets(fx.jet_events(spark, d))
    return v.select("event_id", *[r(f"m{p}", 3).alias(f"m{p}") for p in PAIRS])


@query("c05_dijet_pt", _cols(_same([f"pt{p}" for p in PAIRS]), "dij"))
def dijet_pt(spark, d):
    v = J.with_dijets(fx.jet_events(spark, d))
    return v.select("event_id", *[r(f"pt{p}", 3).alias(f"pt{p}") for p in PAIRS])


@query("c06_jet_distance", _cols(_same([f"dR{p}" for p in PAIRS]), "dij", 6))
def jet_distance(spark, d):
    v = J.with_dijets(fx.jet_events(spark, d))
    return v.select("event_id", *[r(f"dR{p}", 6).alias(f"dR{p}") for p in PAIRS])


@query("c07_dijet_distance", _cols(_same([f"dR{a}{b}" for a, b in PAIRINGS]), "quad", 4))
def dijet_distance(spark, d):
    v = J.with_quadjets(J.with_dijets(fx.jet_events(spark, d)))
    return v.select("event_id", *[r(f"dR{a}{b}", 4).alias(f"dR{a}{b}") for a, b in PAIRINGS])


@query("c08_trijet_mass", _cols({f"m{t}": mass_of(t) for t in J.TRIPLES}, "vec"))
def trijet_mass(spark, d):
    v = J.with_vectors(fx.jet_events(spark, d))
    return v.select("event_id", *[r(J.trijet_mass(t), 3).alias(f"m{t}") for t in J.TRIPLES])


@query("c09_rescaled_pair_mass", _cols(_same([f"mZZ{a}{b}" for a, b in PAIRINGS]), "quad"))
def rescaled_pair_mass(spark, d):
    v = J.with_quadjets(J.with_dijets(fx.jet_events(spark, d)))
    return v.select("event_id", *[r(f"mZZ{a}{b}", 3).alias(f"mZZ{a}{b}") for a, b in PAIRINGS])


@query("c10_two_higgs_mass", _cols(_same(["mHH"]), "wide"))
def two_higgs_mass(spark, d):
    return fx.wide_events(spark, d).select("event_id", r("mHH", 3).alias("mHH"))


@query("c11_four_jet_mass", _cols(_same(["m4j"]), "events4", 4))
def four_jet_mass(spark, d):
    v = J.with_vectors(fx.jet_events(spark, d))
    return v.select("event_id", r(J.four_jet_mass(), 4).alias("m4j"))


def _pairing(rule):
    def run(spark, d):
        p = with_pairing(J.with_dijets(fx.events(spark, d)), rule)
        return p.where(F.col("pairing").isNotNull()).select(
            "event_id", big("pairing").alias("idx"), r("mass_gap", 3).alias("gap"), *[r(c, 3).alias(c) for c in ("lead_m", "subl_m")]
        )

    return run


def _pairing_sql(view: str) -> str:
    return sql(view, f"SELECT {B('event_id')} AS event_id, {B('idx')} AS idx, {R('gap', 3)} AS gap, {R('lead_m', 3)} AS lead_m, {R('subl_m', 3)} AS subl_m FROM {view}")


query("c12_pairing_selection", _pairing_sql("pair_sel"))(_pairing(SELECTION))
query("c13_pairing_mass_plane", _pairing_sql("pair_plane"))(_pairing(MASS_PLANE))


@query("c14_unsigned_phi", _cols({f"phi{i}": unsigned(f"phi{i} + 2.5") for i in range(4)}, "ev", 6))
def unsigned_phi(spark, d):
    j = F.col("jets")
    return fx.jet_events(spark, d).select("event_id", *[
        r(fv.unsigned_phi(j[i]["phi"] + 2.5), 6).alias(f"phi{i}") for i in range(4)
    ])


@query("c15_scalar_pt_sum", _cols({"s4j": "pt0 + pt1 + pt2 + pt3"}, "ev", 4))
def scalar_pt_sum(spark, d):
    return fx.jet_events(spark, d).select("event_id", r(J.scalar_pt_sum(F.col("jets")), 4).alias("s4j"))


@query("c16_longitudinal_sum", _cols({"sum_pz": "pz0 + pz1 + pz2 + pz3"}, "vec", 4))
def longitudinal_sum(spark, d):
    return fx.jet_events(spark, d).select("event_id", r(J.longitudinal_sum(F.col("jets")), 4).alias("sum_pz"))


_SIGNS = [(a, b, c) for a in "+-" for b in "+-" for c in "+-"]
_THRUST = "greatest(" + ", ".join(
    f"sqrt((px0 {a} px1 {b} px2 {c} px3) ** 2 + (py0 {a} py1 {b} py2 {c} py3) ** 2)" for a, b, c in _SIGNS
) + ")"


@query("c17_thrust", sql("vec", f"""SELECT {B('event_id')} AS event_id, {R('thrust', 4)} AS thrust, {R('projected', 4)} AS projected FROM
    (SELECT event_id, {_THRUST} AS thrust, {_THRUST} AS projected FROM vec) t"""))
def thrust_value(spark, d):
    """The axis is checked through the projections on it, which have to add up to the value."""
    j = F.col("jets")
    t = fx.jet_events(spark, d).withColumn("t", thrust(j))
    terms = [j[i]["pt"] * F.abs(F.cos(j[i]["phi"] - F.col("t.phi"))) for i in range(4)]
    return t.select("event_id", r("t.value", 4).alias("thrust"), r(terms[0] + terms[1] + terms[2] + terms[3], 4).alias("projected"))


@query("c18_thrust_scan", sql("vec", f"""SELECT {B('event_id')} AS event_id, {R('max(t)', 4)} AS best FROM (SELECT event_id,
    pt0 * abs(cos(phi0 - a)) + pt1 * abs(cos(phi1 - a)) + pt2 * abs(cos(phi2 - a)) + pt3 * abs(cos(phi3 - a)) AS t
    FROM vec, (SELECT range * (2 * pi() / 100) AS a FROM range(101)) g) s GROUP BY event_id"""))
def thrust_grid(spark, d):
    return fx.jet_events(spark, d).select("event_id", r(thrust_scan(F.col("jets"), 101), 4).alias("best"))


@query("c19_symmetries", _cols({
    "rotated": unsigned("phi0 + 1.25"), "eta_flipped": "-eta1", "phi_flipped": "-phi2"}, "ev", 6))
def symmetries(spark, d):
    j = F.col("jets")
    return fx.jet_events(spark, d).select(
        "event_id", r(J.rotate_phi(j, F.lit(1.25))[0]["phi"]).alias("rotated"),
        r(J.flip_eta(j)[1]["eta"]).alias("eta_flipped"), r(J.flip_phi(j)[2]["phi"]).alias("phi_flipped"),
    )


@query("c20_symmetry_copies", sql("ev", f"""SELECT {B('variant')} AS variant, {B('count(*)')} AS n, {R('sum(ve * eta0)', 3)} AS sum_eta,
    {R('sum(vp * phi1)', 3)} AS sum_phi FROM ev, (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) v(variant, ve, vp) GROUP BY variant"""))
def symmetry_copies(spark, d):
    c = fx.jet_events(spark, d).select(F.explode(J.symmetry_copies(F.col("jets"))).alias("c"))
    return c.groupBy(big("c.variant").alias("variant")).agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum(F.col("c.jets")[0]["eta"]), 3).alias("sum_eta"),
        r(F.sum(F.col("c.jets")[1]["phi"]), 3).alias("sum_phi"),
    )


@query("c20_rotated_copies")
def rotated_copies(spark, d):
    """Training copies with one random rotation per event; the opening angles must not change."""
    e = fx.jet_events(spark, d)
    c = e.select("event_id", F.explode(J.symmetry_copies(F.col("jets"), J.seeded_angle(F.col("event_id"), 7))).alias("c"))
    j = F.col("c.jets")
    return c.select(
        "event_id", F.col("c.variant").alias("variant"), r(j[0]["phi"]).alias("phi0"),
        r(F.abs(fv.wrap_phi(j[0]["phi"] - j[1]["phi"]))).alias("opening"),
    )


@query("c21_odds", _cols({"odds": "h / (1 - h)"}, "events4", 5))
def odds(spark, d):
    return fx.events(spark, d).select("event_id", r(S.odds(F.col("h")), 5).alias("odds"))


_FEATURES = (
    [f"{c}{i}" for c in ("pt", "eta", "phi", "m") for i in "012302130312"]
    + [f"m{p}" for p in PAIRS] + [f"dR{p}" for p in PAIRS] + [f"dR{a}{b}" for a, b in PAIRINGS] + ["m4j"] * 3
)


@query("c22_feature_vector", sql("quad", " UNION ALL ".join(
    f"SELECT {B(str(k))} AS slot, {R(f'sum({x})', 2)} AS total, {R(f'max({x})', 3)} AS largest FROM quad" for k, x in enumerate(_FEATURES))))
def feature_vector(spark, d):
    e = J.with_quadjets(J.with_dijets(fx.events(spark, d)))
    x = e.select(F.posexplode(J.feature_vector()).alias("slot", "x"))
    return x.groupBy(big("slot").alias("slot")).agg(r(F.sum("x"), 2).alias("total"), r(F.max("x"), 3).alias("largest"))


@query("c23_sigmoid_softmax", sql("events4", f"""SELECT {B('event_id')} AS event_id, {R('p', 6)} AS sigmoid,
    {R('exp(z) / (exp(z) + exp(-z))', 6)} AS softmax_1, {B('CASE WHEN p >= 0.5 THEN 1 ELSE 0 END')} AS predicted
    FROM (SELECT event_id, (sT - 618) / 200 AS z, 1 / (1 + exp(-(sT - 618) / 200)) AS p FROM events4) t"""))
def sigmoid_softmax(spark, d):
    z = (F.col("sT") - 618) / 200
    e = fx.events(spark, d).select("event_id", z.alias("z"))
    p = S.sigmoid(F.col("z"))
    return e.select(
        "event_id", r(p).alias("sigmoid"), r(S.softmax(-F.col("z"), F.col("z"))[1]).alias("softmax_1"),
        big(S.hard_label(p)).alias("predicted"),
    )


@query("c24_class_ratio", _cols({"ratio": "h / (1 - h)"}, "events4", 5))
def class_ratio(spark, d):
    return fx.events(spark, d).select("event_id", r(S.class_ratio(F.col("h"), 1 - F.col("h")), 5).alias("ratio"))


@query("c25_reweighting_curve", sql("", f"""SELECT {B('b')} AS bin, {R('CASE WHEN b <= 20 THEN c / (1 - c) END', 6)} AS expected, {B('n')} AS n
    FROM (SELECT b, (b - 0.5) / 20 AS c, n FROM (SELECT CASE WHEN value < 500 THEN floor(value / 25) + 1 ELSE 21 END AS b, count(*) AS n FROM events GROUP BY 1) t) u"""))
def reweighting_curve(spark, d):
    """Expected odds at the centre of each filled score bin (the score is value / 500); bin 21 is the overflow, without odds."""
    e = fx.table(spark, d, "events")
    bins = e.groupBy(F.when(F.col("value") < 500, F.floor(F.col("value") / 25) + 1).otherwise(21).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    centre = (F.col("bin") - 0.5) / 20
    return bins.select(big("bin").alias("bin"), r(F.when(F.col("bin") <= 20, S.odds(centre))).alias("expected"), big("n").alias("n"))
