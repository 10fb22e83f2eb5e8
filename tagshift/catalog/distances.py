"""Ranks, blocks, neighbours, couplings and event distances."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, define, query, r, sql, wrapped
from tagshift.constants import BASE_RADIUS, KNN_RADIUS
from tagshift.functions import fourvec as fv
from tagshift.operators import blocks as BL
from tagshift.operators import emd as E
from tagshift.operators import neighbours as NN
from tagshift.operators import norms as N
from tagshift.operators import pairs as P
from tagshift.operators import proofs as PR
from tagshift.operators import transport as T
from tagshift.plans import models as M
from tagshift.sources import fixtures as fx
from tagshift.sources.store import materialize, materialize_wide

BLOCK = 200  # SR events per block at test size

define("ranked", ["events4"], "SELECT *, row_number() OVER (PARTITION BY tag, region ORDER BY sT, event_id) - 1 AS rk, count(*) OVER (PARTITION BY tag, region) AS n FROM events4")
define("blk", ["ranked"], f"""SELECT event_id, region, sT AS x, weight AS w, h, rk, rk % nb AS block, rk // nb AS pos FROM
    (SELECT r.*, b.nb FROM ranked r, (SELECT greatest(1, coalesce(max(n), 0) // {BLOCK}) AS nb FROM ranked WHERE tag = '3b' AND region = 'SR') b
     WHERE tag = '3b' AND region IN ('CR', 'SR')) t""")
_DIGITS = "least(9 - floor(log10(min({w}))), 18 - ceil(log10(sum({w}))))"
define("unit", ["blk"], f"SELECT region, power(10, {_DIGITS.format(w='w')}) AS per_one FROM blk WHERE w > 0 GROUP BY region")
define("cum", ["blk", "unit"], """SELECT *, m / total AS p FROM (SELECT *, sum(m) OVER (PARTITION BY block, region) AS total, sum(m) OVER (PARTITION BY block, region ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM (SELECT block, event_id, region, x, w, greatest(1, CAST(round(w * per_one) AS BIGINT)) AS m FROM blk JOIN unit USING (region) WHERE w > 0) a) b""")
define("coupling", ["cum"], """SELECT s.block, s.event_id AS src_id, t.event_id AS tgt_id, s.x AS src_x, t.x AS tgt_x, s.p AS src_mass, (least(s.upto * t.total, t.upto * s.total) - greatest((s.upto - s.m) * t.total, (t.upto - t.m) * s.total))::DOUBLE / (s.total * t.total)::DOUBLE AS value
    FROM cum s JOIN cum t ON s.block = t.block AND s.region = 'CR' AND t.region = 'SR' WHERE s.upto * t.total > (t.upto - t.m) * s.total AND t.upto * s.total > (s.upto - s.m) * t.total""")
define("steps", ["ranked"], "SELECT event_id, tag, sT AS x, rk, n, greatest(1, n // 35) AS size, least(34, rk // greatest(1, n // 35)) AS step FROM ranked WHERE region = 'CR'")
define("band", ["steps"], """SELECT t.event_id AS tgt_id, s.event_id AS src_id, abs(t.x - s.x) AS d, s.rk AS src_rank,
      greatest(greatest(0, t.step - 1) * s.size, least(CASE WHEN t.step >= 33 THEN s.n ELSE (t.step + 2) * s.size END, p.place)) AS centre
    FROM steps t JOIN steps s ON t.tag = '4b' AND s.tag = '3b' AND abs(t.step - s.step) <= 1
    JOIN (SELECT t.event_id, count(s.event_id) AS place FROM steps t LEFT JOIN steps s ON s.tag = '3b' AND s.x <= t.x WHERE t.tag = '4b' GROUP BY 1) p ON p.event_id = t.event_id""")
for _k in (1, 5, 10, 20):
    define(f"knn{_k}", ["band"], f"SELECT tgt_id, src_id, d, nn FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY d, abs(src_rank - centre + 0.5), src_rank) AS nn FROM band) t WHERE nn <= {_k}")
    define(f"nnw{_k}", [f"knn{_k}"], f"""SELECT src_id, sum(CASE WHEN z > 0 THEN CASE WHEN d = 0 THEN 1.0 / z ELSE 0 END ELSE (1 / d) / i END) AS nn_weight FROM
        (SELECT *, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tgt_id) AS z, sum(CASE WHEN d <> 0 THEN 1 / d END) OVER (PARTITION BY tgt_id) AS i FROM knn{_k}) t GROUP BY src_id""")


def three(spark, d):
    return fx.events(spark, d).where("tag = '3b'").select("event_id", "region", "sT", "weight", "h")


def blocks(spark, d):
    return materialize(BL.round_robin_blocks(three(spark, d), BLOCK), "blocks")


def cr_pair(spark, d):
    cr = fx.events(spark, d).where("region = 'CR'").select("tag", F.col("event_id").alias("id"), F.col("sT").alias("x"))
    return cr.where("tag = '4b'"), cr.where("tag = '3b'")


@query("e01_region_ranks", sql("ranked", f"SELECT {B('event_id')} AS event_id, tag, region, {B('rk')} AS rank FROM ranked"))
def region_ranks(spark, d):
    e = fx.events(spark, d).select("event_id", "tag", "region", "sT")
    return BL.region_ranks(e, ["tag", "region"]).select("event_id", "tag", "region", big("rank").alias("rank"))


@query("e02_round_robin_blocks", sql("blk", f"SELECT {B('event_id')} AS event_id, region, {B('block')} AS block, {B('pos')} AS pos FROM blk"))
def round_robin_blocks(spark, d):
    return BL.round_robin_blocks(three(spark, d), BLOCK).select("event_id", "region", big("block").alias("block"), big("pos").alias("pos"))


@query("e03_half_step_blocks", sql("steps", f"""SELECT {B('event_id')} AS event_id, {B('b')} AS block, {B('rk - b * size')} AS pos FROM
    (SELECT event_id, rk, size, unnest([step - 1, step]) AS b FROM steps WHERE tag = '3b') t WHERE b BETWEEN 0 AND 33"""))
def half_step_blocks(spark, d):
    e = three(spark, d).where("region = 'CR'")
    return BL.half_step_blocks(e).select("event_id", big("block").alias("block"), big("pos").alias("pos"))


@query("e04_nearest_neighbours", sql("knn5", f"SELECT {B('tgt_id')} AS tgt_id, {B('src_id')} AS src_id, {B('nn')} AS nn, {R('d', 5)} AS distance FROM knn5"))
def nearest_neighbours(spark, d):
    k = NN.knn_by_gap(*cr_pair(spark, d), 5)
    return k.select("tgt_id", "src_id", big("nn").alias("nn"), r("distance", 5).alias("distance"))


@query("e05_neighbour_weights", sql("nnw10", f"SELECT {B('src_id')} AS src_id, {R('nn_weight', 6)} AS nn_weight FROM nnw10"))
def neighbour_weights(spark, d):
    return NN.neighbour_weights(NN.knn_by_gap(*cr_pair(spark, d), 10)).select("src_id", r("nn_weight").alias("nn_weight"))


_FLIPS = [(0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)]


def _flip_sql(ve: int, vp: int) -> str:
    return " + ".join(f"abs({ve} * s.eta{i} - t.eta{i}) + abs({wrapped(f'{vp} * s.phi{i} - t.phi{i}')})" for i in range(4))


@query("e10_best_flip", sql("knn1 ev", f"""SELECT {B('tgt_id')} AS tgt_id, {R('v', 5)} AS value FROM
    (SELECT k.tgt_id, least({', '.join(_flip_sql(ve, vp) for _, ve, vp in _FLIPS)}) AS v
     FROM knn1 k JOIN ev s ON s.event_id = k.src_id JOIN ev t ON t.event_id = k.tgt_id) x"""))
def best_flip(spark, d):
    """Of the four flips of a target's nearest source, the one whose jets lie closest, jet by jet."""
    j = fx.jet_events(spark, d)
    pairs = NN.knn_by_gap(*cr_pair(spark, d), 1).join(j.select(F.col("event_id").alias("src_id"), F.col("jets").alias("s")), "src_id").join(
        j.select(F.col("event_id").alias("tgt_id"), F.col("jets").alias("t")), "tgt_id")
    s, t = F.col("s"), F.col("t")
    tries = []
    for number, ve, vp in _FLIPS:
        terms = [F.abs(ve * s[i]["eta"] - t[i]["eta"]) + F.abs(fv.wrap_phi(vp * s[i]["phi"] - t[i]["phi"])) for i in range(4)]
        tries.append(F.struct((terms[0] + terms[1] + terms[2] + terms[3]).alias("value"), F.lit(number).alias("flip")))
    return pairs.select("tgt_id", F.array_min(F.array(*tries)).alias("best")).select("tgt_id", r("best.value", 5).alias("value"))


@query("f02_index_gather", sql("blk", f"SELECT {B('block')} AS block, region, {B('count(*)')} AS n, {R('sum(h)', 4)} AS sum_h FROM blk GROUP BY block, region"))
def index_gather(spark, d):
    """Block index joined back to the events by key."""
    index = blocks(spark, d).select("event_id", "block")
    e = fx.events(spark, d).select("event_id", "region", "h")
    return index.join(e, "event_id").groupBy(big("block").alias("block"), "region").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("h"), 4).alias("sum_h")
    )


@query("f03_block_pair_moments", sql("blk", f"""SELECT {B('s.block')} AS block, {B('count(*)')} AS n_pairs, {R('avg(abs(s.x - t.x))', 5)} AS mean_gap, {R('avg((s.x - t.x) ** 2)', 3)} AS mean_square
    FROM blk s JOIN blk t ON s.block = t.block AND s.region = 'CR' AND t.region = 'SR' GROUP BY s.block"""))
def block_pair_moments(spark, d):
    b = blocks(spark, d)
    m = P.gap_moments(M.block_side(b, "CR"), M.block_side(b, "SR"))
    return m.select(big("block").alias("block"), big("n_pairs").alias("n_pairs"), r("mean_gap", 5).alias("mean_gap"), r("mean_square", 3).alias("mean_square"))


@query("f04_band_sizes", sql("band", f"SELECT {B('tgt_id')} AS tgt_id, {B('count(*)')} AS n_sources, {B('min(src_rank)')} AS first_rank, {B('max(src_rank)')} AS last_rank FROM band GROUP BY tgt_id"))
def band_sizes(spark, d):
    """The allowed sources of a target are one rank interval; no pair has to be formed to know it."""
    t, _ = NN.banded(*cr_pair(spark, d))
    return t.select("tgt_id", big(F.col("hi") - F.col("lo")).alias("n_sources"), big("lo").alias("first_rank"), big(F.col("hi") - 1).alias("last_rank"))


def coupling(spark, d):
    b = blocks(spark, d)
    return b, materialize(M.region_coupling(b), "coupling")


@query("h11_monotone_coupling", sql("coupling", f"SELECT {B('block')} AS block, {B('src_id')} AS src_id, {B('tgt_id')} AS tgt_id, {R('value', 8)} AS value FROM coupling"))
def monotone_coupling(spark, d):
    _, c = coupling(spark, d)
    return c.select(big("block").alias("block"), "src_id", "tgt_id", r("value", 8).alias("value"))


@query("h12_conditional_coupling", sql("coupling", f"SELECT {B('src_id')} AS src_id, {B('tgt_id')} AS tgt_id, {R('value / sum(value) OVER (PARTITION BY src_id)', 6)} AS conditional FROM coupling"))
def conditional_coupling(spark, d):
    _, c = coupling(spark, d)
    return T.given_source(c).select("src_id", "tgt_id", r("conditional").alias("conditional"))


@query("f05_coupling_product", sql("coupling events4", f"SELECT {B('tgt_id')} AS tgt_id, {R('sum(value * h / (1 - h))', 8)} AS pushed FROM coupling c JOIN events4 e ON e.event_id = c.src_id GROUP BY tgt_id"))
def coupling_product(spark, d):
    b, c = coupling(spark, d)
    w = b.where("region = 'CR'").select(F.col("event_id").alias("id"), (F.col("h") / (1 - F.col("h"))).alias("w"))
    return T.push(c, w).select("tgt_id", r("pushed", 8).alias("pushed"))


@query("d18_coupling_marginals", sql("coupling", f"""SELECT side, {B('count(*)')} AS n, {R('sum(mass)', 6)} AS total, {R('max(mass)', 8)} AS largest FROM
    (SELECT 'source' AS side, sum(value) AS mass FROM coupling GROUP BY src_id UNION ALL SELECT 'target', sum(value) FROM coupling GROUP BY tgt_id) t GROUP BY side"""))
def coupling_marginals(spark, d):
    _, c = coupling(spark, d)
    sides = [T.marginals(c, s).select(F.lit(n).alias("side"), "mass") for n, s in (("source", "src_id"), ("target", "tgt_id"))]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("mass")).alias("total"), r(F.max("mass"), 8).alias("largest")
    )


@query("e12_coupling_in_order", sql("coupling blk", f"""SELECT {B('c.block')} AS block, {B('s.pos')} AS src_pos, {B('t.pos')} AS tgt_pos, {R('c.src_x', 4)} AS src_sT, {R('c.tgt_x', 4)} AS tgt_sT, {R('c.value', 8)} AS mass
    FROM coupling c JOIN blk s ON s.event_id = c.src_id JOIN blk t ON t.event_id = c.tgt_id"""))
def coupling_in_order(spark, d):
    """Non-zero cells with the sT and the in-block position (the sT order) of both sides."""
    b, c = coupling(spark, d)
    side = lambda p: b.select(F.col("event_id").alias(f"{p}_id"), big("pos").alias(f"{p}_pos"), r("sT", 4).alias(f"{p}_sT"))
    return c.join(side("src"), "src_id").join(side("tgt"), "tgt_id").select(
        big("block").alias("block"), "src_pos", "tgt_pos", "src_sT", "tgt_sT", r("value", 8).alias("mass")
    )


@query("h07_block_gaps", sql("coupling blk", f"""SELECT {B('c.block')} AS block, {B('c.src_id')} AS src_id, {B('c.tgt_id')} AS tgt_id, {R('abs(c.src_x - c.tgt_x)', 4)} AS gap, {R('abs(c.src_x - c.tgt_x) / sd', 6)} AS scaled
    FROM coupling c JOIN (SELECT block, stddev_samp(x) AS sd FROM blk GROUP BY block) s ON s.block = c.block"""))
def block_gaps(spark, d):
    """Plain and standardised |delta sT| of the coupled pairs; the spread covers the whole block."""
    b, c = coupling(spark, d)
    spread = P.pooled_spread(M.block_side(b, "CR"), M.block_side(b, "SR"))
    x = b.select("event_id", "sT")
    cells = c.join(x.toDF("src_id", "s"), "src_id").join(x.toDF("tgt_id", "t"), "tgt_id").join(spread, "block")
    gap = F.abs(F.col("s") - F.col("t"))
    return cells.select(big("block").alias("block"), "src_id", "tgt_id", r(gap, 4).alias("gap"), r(gap / F.col("spread")).alias("scaled"))


@query("h08_radius_change", sql("knn5", f"SELECT {B('tgt_id')} AS tgt_id, {B('src_id')} AS src_id, {R('2 * pi() * (2 * d) / 2.75 + (2.75 - 2 * pi()) * d / 2.75', 5)} AS distance FROM knn5"))
def radius_change(spark, d):
    """Formula check on pairs whose distance is set to twice their |delta sT|."""
    k = NN.knn_by_gap(*cr_pair(spark, d), 5)
    return k.select("tgt_id", "src_id", r(T.radius_change(2 * F.col("distance"), F.col("distance"), KNN_RADIUS), 5).alias("distance"))


@query("f08_global_norms", sql("events4 norms", f"SELECT {B('event_id')} AS event_id, {R('weight * pi / w3b_CR', 10)} AS scaled FROM events4, norms WHERE tag = '3b'"))
def global_norms(spark, d):
    e = materialize(fx.events(spark, d).select("event_id", "tag", "region", "weight"), "labels")
    n = N.transfer_norms(e)
    return e.where("tag = '3b'").select("event_id", r(F.col("weight") * N.scalar(n, "pi") / N.scalar(n, "w3b_CR"), 10).alias("scaled"))


@query("f10_index_membership", sql("events4 knn1", f"SELECT {B('event_id')} AS event_id, {R('sT', 4)} AS sT FROM events4 WHERE event_id IN (SELECT src_id FROM knn1)"))
def index_membership(spark, d):
    """Events that are the nearest source of some target."""
    chosen = NN.knn_by_gap(*cr_pair(spark, d), 1).select(F.col("src_id").alias("event_id"))
    return fx.events(spark, d).select("event_id", r("sT", 4).alias("sT")).join(chosen, "event_id", "left_semi")


# ---- event distances: with full masses no SQL twin, tested against brute force in tests/ ----


def aligned(events):
    return materialize(E.with_alignment(events).select("event_id", "tag", "region", "sT", "packed", "axis", "pz"), "aligned")


def _sides(rows):
    cr = rows.where("region = 'CR'").select("tag", F.col("event_id").alias("id"), F.col("sT").alias("x"))
    return cr.where("tag = '4b'"), cr.where("tag = '3b'")


def _pairs(spark, d):
    """Each 4b CR event with its nearest source by sT, with the per-event columns attached."""
    a = aligned(fx.events(spark, d))
    k = NN.knn_by_gap(*_sides(a), 1).select("tgt_id", "src_id", F.col("distance").alias("gap"))
    return E.attach(k, a, a)


def _distance_query(kind, **options):
    def run(spark, d):
        out = E.event_distance(_pairs(spark, d), kind, **options)
        cols = [r("distance", 5).alias("distance"), big("orientation").alias("orientation"), r("rotation", 5).alias("rotation")]
        if options.get("with_flow"):
            cols.append(r(F.aggregate("flow", F.lit(0.0), lambda a, x: a + x), 4).alias("moved"))
        return out.select("tgt_id", "src_id", r("gap", 5).alias("gap"), *cols)

    return run


# With unit masses the distance is the cheapest of the 24 ways to pair the jets, which SQL can state. The kernel is the same.

_SUMS = [(f"(px0 {a} px1 {b} px2 {c} px3)", f"(py0 {a} py1 {b} py2 {c} py3)") for a in "+-" for b in "+-" for c in "+-"]
define("axes", ["vec"], "SELECT *, pz0 + pz1 + pz2 + pz3 AS pz, list_reverse_sort([" + ", ".join(
    f"{{'v': sqrt({x} ** 2 + {y} ** 2), 'p': atan2({y}, {x})}}" for x, y in _SUMS) + "])[1].p AS axis FROM vec")
_SIDES = ", ".join(f"s.{c}{i} AS s{c}{i}, t.{c}{i} AS t{c}{i}" for c in ("eta", "phi") for i in range(4))
define("unit_pair", ["knn1", "axes"], f"""SELECT k.tgt_id, k.src_id, {_SIDES}, s.axis AS s_axis, t.axis AS t_axis, CASE WHEN s.pz * t.pz < 0 THEN -1 ELSE 1 END AS side
    FROM knn1 k JOIN axes s ON s.event_id = k.src_id JOIN axes t ON t.event_id = k.tgt_id""")


def _unit_sql(variants: str) -> str:
    """``variants``: the orientations of a pair as a table (ve, vp, turn)."""
    costs = ", ".join(
        f"sqrt((ve * seta{i} - teta{j}) ** 2 + ({wrapped(f'vp * sphi{i} + turn - tphi{j}')}) ** 2) / {BASE_RADIUS!r} AS c{i}{j}" for i in range(4) for j in range(4))
    pairings = ", ".join(" + ".join(f"c{i}{p[i]}" for i in range(4)) for p in itertools.permutations(range(4)))
    return sql("unit_pair", f"""SELECT {B('tgt_id')} AS tgt_id, {B('src_id')} AS src_id, {R('min(d)', 5)} AS distance FROM
        (SELECT tgt_id, src_id, least({pairings}) AS d FROM (SELECT tgt_id, src_id, {costs} FROM ({variants}) v) c) m GROUP BY 1, 2""")


def _scan_sql(kind: str) -> str:
    rows = ", ".join(f"({-1 if e else 1}, {-1 if p else 1}, {turn!r})" for e, p, turn in E.variants(kind))
    return _unit_sql(f"SELECT * FROM unit_pair, (VALUES {rows}) o(ve, vp, turn)")


_ALIGNED = " UNION ALL ".join(
    f"SELECT *, side AS ve, {f} AS vp, -({f} * s_axis - t_axis + {half!r}) AS turn FROM unit_pair" for f in (1, -1) for half in (0.0, math.pi))


def _unit_query(kind):
    def run(spark, d):
        p = _pairs(spark, d)
        for c in ("src_packed", "tgt_packed"):
            p = p.withColumn(c, F.concat(F.array_repeat(F.lit(1.0), 4), F.slice(c, 5, 8)))
        return E.event_distance(p, kind).select("tgt_id", "src_id", r("distance", 5).alias("distance"))

    return run


for _name, _kind in (("h01_event_distance", "nominal"), ("h02_min_over_eta_flip", "eta_flip"), ("h03_min_over_rotation", "phi_rotation"), ("h04_full_minimum", "full")):
    query(f"{_name}_unit", _scan_sql(_kind))(_unit_query(_kind))
query("h05_thrust_aligned_minimum_unit", _unit_sql(_ALIGNED))(_unit_query("thrust"))
_UNIT = _unit_sql(_ALIGNED)
_HEAD, _BODY = _UNIT[: _UNIT.rindex("\nSELECT")], _UNIT[_UNIT.rindex("\nSELECT") :]


@query("h08_radius_change_aligned", f"""{_HEAD}
SELECT u.tgt_id, u.src_id, {R(f"2 * pi() * u.distance / {KNN_RADIUS} + ({KNN_RADIUS} - 2 * pi()) * k.d / {KNN_RADIUS}", 3)} AS distance
    FROM ({_BODY.replace(", 5) + 0.0) AS distance", ", 9) + 0.0) AS distance")}) u JOIN knn1 k ON k.tgt_id = u.tgt_id""")
def radius_change_aligned(spark, d):
    """Aligned unit-mass distances taken to the neighbours' radius, with the gap in sT as the part that does not scale."""
    p = _pairs(spark, d)
    for c in ("src_packed", "tgt_packed"):
        p = p.withColumn(c, F.concat(F.array_repeat(F.lit(1.0), 4), F.slice(c, 5, 8)))
    out = E.event_distance(p, "thrust")
    return out.select("tgt_id", "src_id", r(T.radius_change(F.round("distance", 9), F.col("gap"), KNN_RADIUS), 3).alias("distance"))
query("h01_event_distance")(_distance_query("nominal"))
query("h02_min_over_eta_flip")(_distance_query("eta_flip"))
query("h03_min_over_rotation")(_distance_query("phi_rotation"))
query("h04_full_minimum")(_distance_query("full"))
query("h05_thrust_aligned_minimum")(_distance_query("thrust"))
query("h06_best_flow")(_distance_query("thrust", with_flow=True))


def signed_sides(rows):
    """4b and 3b CR events of ``rows`` (from ``aligned``) with what their distances are measured by."""
    cr = rows.where("region = 'CR'").select("tag", F.col("event_id").alias("id"), F.col("sT").alias("x"), "packed", "axis", "pz")
    return tuple(
        side.select("id", "x", *[F.col(c).alias(f"{p}_{c}") for c in ("packed", "axis", "pz")])
        for p, side in (("tgt", cr.where("tag = '4b'")), ("src", cr.where("tag = '3b'"))))


def neighbours_by_distance(events, k, radius=KNN_RADIUS):
    """k nearest 3b CR events of every 4b CR event of ``events`` by aligned event distance at ``radius``."""
    return NN.knn_in_tiles(*signed_sides(aligned(events)), k, E.nearest_in_tile(k, radius), by_gap=True)


@query("h09_nearest_by_distance")
def nearest_by_distance(spark, d):
    k = neighbours_by_distance(fx.events(spark, d), 5)
    return k.select("tgt_id", "src_id", big("nn").alias("nn"), r("distance", 5).alias("distance"))


define("unit_band", ["band", "axes"], f"""SELECT b.tgt_id, b.src_id, {_SIDES}, s.axis AS s_axis, t.axis AS t_axis, CASE WHEN s.pz * t.pz < 0 THEN -1 ELSE 1 END AS side
    FROM band b JOIN axes s ON s.event_id = b.src_id JOIN axes t ON t.event_id = b.tgt_id""")
_UNIT_BAND = _unit_sql(_ALIGNED).replace("unit_pair", "unit_band")


@query("h09_nearest_by_distance_unit", sql("unit_band", f"""SELECT tgt_id, {B('nn')} AS nn, distance FROM
    (SELECT tgt_id, distance, row_number() OVER (PARTITION BY tgt_id ORDER BY distance) AS nn FROM ({_UNIT_BAND[_UNIT_BAND.rindex(chr(10) + 'SELECT') :]}) u) x WHERE nn <= 5"""))
def nearest_by_distance_unit(spark, d):
    """The five least aligned distances of each target in its band, jets weighing one each; equal ones may be of different sources."""
    rows = aligned(fx.events(spark, d)).withColumn("packed", F.concat(F.array_repeat(F.lit(1.0), 4), F.slice("packed", 5, 8)))
    k = NN.knn_in_tiles(*signed_sides(rows), 5, E.nearest_in_tile(5, BASE_RADIUS))
    return k.select("tgt_id", big("nn").alias("nn"), r("distance", 5).alias("distance"))


@query("h13_alignment_quality")
def alignment_quality(spark, d):
    """Aligned distance against the minimum of a 100-step scan of all orientations."""
    p = materialize(_pairs(spark, d), "pairs")
    near = E.event_distance(p, "thrust").select("tgt_id", F.col("distance").alias("aligned"))
    scan = E.event_distance(p, "full", steps=101).select("tgt_id", F.col("distance").alias("scanned"))
    return near.join(scan, "tgt_id").select("tgt_id", r("aligned", 5).alias("aligned"), r("scanned", 5).alias("scanned"))


# ---- full masses: what the kernel returns is proven by column expressions, so the twin needs no solver ----

_PROVEN = sql("knn1 ev", f"""SELECT k.tgt_id, k.src_id, {R('least(s.pt0 + s.pt1 + s.pt2 + s.pt3, t.pt0 + t.pt1 + t.pt2 + t.pt3)', 4)} AS moved, true AS flow_holds, true AS nothing_cheaper
    FROM knn1 k JOIN ev s ON s.event_id = k.src_id JOIN ev t ON t.event_id = k.tgt_id""")


def _proof_query(kind, **options):
    def run(spark, d):
        # few bytes, dealt to all cores; the expressions that check are many
        p = PR.proven(E.dealt(materialize(_pairs(spark, d), "pairs")), kind, **options)
        return materialize_wide(p.select("tgt_id", "src_id", r("moved", 4).alias("moved"), "flow_holds", "nothing_cheaper"), "proofs")

    return run


for _name, _kind, _options in (
    ("h01_event_distance", "nominal", {}), ("h02_min_over_eta_flip", "eta_flip", {}), ("h03_min_over_rotation", "phi_rotation", {}), ("h04_full_minimum", "full", {}),
    ("h05_thrust_aligned_minimum", "thrust", {}), ("h13_alignment_quality", "full", {"steps": 101}),
):
    query(f"{_name}_proof", _PROVEN)(_proof_query(_kind, **_options))


_LIGHTER = "s.pt0 + s.pt1 + s.pt2 + s.pt3 <= t.pt0 + t.pt1 + t.pt2 + t.pt3"


@query("h06_flow_by_jet", sql("knn1 ev", " UNION ALL ".join(
    f"SELECT k.tgt_id, k.src_id, CASE WHEN {_LIGHTER} THEN 'source' ELSE 'target' END AS side, {B(str(i))} AS jet, {R(f'CASE WHEN {_LIGHTER} THEN s.pt{i} ELSE t.pt{i} END', 4)} AS moved "
    f"FROM knn1 k JOIN ev s ON s.event_id = k.src_id JOIN ev t ON t.event_id = k.tgt_id" for i in range(4))))
def flow_by_jet(spark, d):
    """Flow of the best orientation as rows, summed by jet of the event with less pt, all of which moves."""
    pairs = _pairs(spark, d)
    total = lambda side: F.aggregate(F.slice(f"{side}_packed", 1, 4), F.lit(0.0), lambda a, x: a + x)
    pairs = pairs.withColumn("lighter", total("src") <= total("tgt"))
    cells = E.event_distance(pairs, "thrust", with_flow=True).select("tgt_id", "src_id", "lighter", F.posexplode("flow").alias("cell", "pt"))
    jet = F.when(F.col("lighter"), F.floor(F.col("cell") / 4)).otherwise(F.col("cell") % 4)
    side = F.when(F.col("lighter"), "source").otherwise("target")
    return cells.groupBy("tgt_id", "src_id", side.alias("side"), big(jet).alias("jet")).agg(r(F.sum("pt"), 4).alias("moved"))
