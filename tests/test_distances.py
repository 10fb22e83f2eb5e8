"""Event distances, neighbours and couplings against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagshift.catalog import distances as DS
from tagshift.operators import emd as E
from tagshift.operators import neighbours as NN
from tagshift.operators import proofs as PR
from tagshift.operators import transport as T
from tagshift.operators.pairs import gap_moments
from tagshift.sources import fixtures as fx

FULL = 2 * math.pi


def event(*jets):
    return tuple(np.array([[j[k] for j in jets]], float) for k in range(3))


def distance(a, b, radius=FULL):
    return E.transport_cost(a, b, radius)[0][0]


BASE = [(50, 0.1, 0.2), (60, -0.4, 2.0), (70, 1.0, -2.5), (80, -1.2, -0.7)]


def test_distance_edge_rows():
    moved = [(50, 0.6, 0.2), *BASE[1:]]
    heavier = [(60, 0.1, 0.2), *BASE[1:]]
    around = [(50, 0.1, 0.1), *BASE[1:]], [(50, 0.1, 2 * math.pi - 0.1), *BASE[1:]]
    assert distance(event(*BASE), event(*BASE)) == 0
    assert distance(event(*BASE), event(*moved)) == pytest.approx(50 * 0.5 / FULL)
    assert distance(event(*BASE), event(*heavier)) == pytest.approx(10)
    assert distance(event(*around[0]), event(*around[1])) == pytest.approx(50 * 0.2 / FULL)


def random_events(n, seed, integer=False):
    rng = np.random.default_rng(seed)
    pt = rng.integers(1, 4, (n, 4)).astype(float) if integer else rng.uniform(30, 250, (n, 4))
    return pt, rng.uniform(-2.5, 2.5, (n, 4)), rng.uniform(-math.pi, math.pi, (n, 4))


def brute_distance(a, b, i, radius):
    """Best assignment of unit pieces, by trying all for the shorter side."""
    units = [[j for j in range(4) for _ in range(int(e[0][i, j]))] for e in (a, b)]
    flip = len(units[0]) > len(units[1])
    (pa, pb), (few, many) = ((b, a), units[::-1]) if flip else ((a, b), units)
    cost = {
        (x, y): math.hypot(pa[1][i, x] - pb[1][i, y], (pa[2][i, x] - pb[2][i, y] + math.pi) % (2 * math.pi) - math.pi) / radius
        for x in range(4) for y in range(4)
    }
    best = {tuple(many.count(y) for y in range(4)): 0.0}
    for x in few:
        nxt = {}
        for left, c in best.items():
            for y in range(4):
                if left[y]:
                    key = left[:y] + (left[y] - 1,) + left[y + 1:]
                    nxt[key] = min(nxt.get(key, math.inf), c + cost[x, y])
        best = nxt
    return min(best.values()) + len(many) - len(few)


@pytest.mark.parametrize("radius", [FULL, 0.4])
def test_distance_is_optimal(radius):
    a, b = random_events(40, 1, True), random_events(40, 2, True)
    got, flow = E.transport_cost(a, b, radius)
    want = [brute_distance(a, b, i, radius) for i in range(40)]
    # below R = 0.4 leaving pt in place can be cheaper than moving it, but the definition moves all it can
    assert got == pytest.approx(np.array(want), abs=1e-9)
    assert flow.sum(axis=(1, 2)) == pytest.approx(np.minimum(a[0].sum(1), b[0].sum(1)))


def test_distance_properties():
    a, b = random_events(300, 3), random_events(300, 4)
    d = E.transport_cost(a, b, FULL)[0]
    assert d == pytest.approx(E.transport_cost(b, a, FULL)[0])
    assert (d >= np.abs(a[0].sum(1) - b[0].sum(1)) - 1e-9).all()
    flips = E.best_orientation(a, b, FULL, "eta_flip")[0]
    turns = E.best_orientation(a, b, FULL, "phi_rotation")[0]
    full = E.best_orientation(a, b, FULL, "full")[0]
    assert (flips <= d + 1e-9).all() and (full <= turns + 1e-9).all() and (turns <= d + 1e-9).all()


def test_radius_change():
    a, b = random_events(100, 5), random_events(100, 6)
    gap = np.abs(a[0].sum(1) - b[0].sum(1))
    base = E.transport_cost(a, b, FULL)[0]
    for radius in (2.75, 0.4):
        assert FULL * base / radius + (radius - FULL) * gap / radius == pytest.approx(E.transport_cost(a, b, radius)[0])


def test_prices_prove_and_disprove():
    """Prices of a cheapest flow add up to its cost; those of another one do not."""
    a, b = random_events(200, 7), random_events(200, 8)
    value, flow, prices = E.transport_cost(a, b, FULL, proof=True)
    diff = a[0].sum(1) - b[0].sum(1)
    worth = (np.hstack([a[0], np.maximum(-diff, 0)[:, None], b[0], np.maximum(diff, 0)[:, None]]) * prices).sum(1)
    assert worth == pytest.approx(value)


@pytest.mark.parametrize("kind", ["nominal", "thrust"])
def test_proofs_see_wrong_distances(cr, monkeypatch, kind):
    t, s = cr.where("tag = '4b'").limit(6), cr.where("tag = '3b'").limit(6)
    pairs = t.select(F.col("event_id").alias("tgt_id")).crossJoin(s.select(F.col("event_id").alias("src_id")))
    pairs = E.attach(pairs, cr, cr)
    good = PR.proven(pairs, kind).collect()
    assert len(good) == 36 and all(r.flow_holds and r.nothing_cheaper for r in good)
    true = PR.event_distance
    monkeypatch.setattr(PR, "event_distance", lambda *a, **k: true(*a, **k).withColumn("distance", F.col("distance") + 0.01))
    assert not any(r.flow_holds or r.nothing_cheaper for r in PR.proven(pairs, kind).collect())
    # a flow that is none, and prices above the costs
    monkeypatch.setattr(PR, "event_distance", lambda *a, **k: true(*a, **k).withColumn("flow", F.transform("flow", lambda x: x * 1.01)).withColumn(
        "prices", F.transform("prices", lambda y: F.transform(y, lambda x: x + 0.01))))
    assert not any(r.flow_holds or r.nothing_cheaper for r in PR.proven(pairs, kind).collect())


@pytest.fixture(scope="module")
def cr(spark, sf_dir):
    e = E.with_alignment(fx.events(spark, sf_dir).where("region = 'CR'")).select("event_id", "tag", "sT", "packed", "axis", "pz")
    return e.cache()


@pytest.mark.parametrize("kind", ["nominal", "eta_flip", "phi_rotation", "thrust"])
def test_spark_distance_equals_kernel(cr, kind):
    t = cr.where("tag = '4b'").limit(20)
    s = cr.where("tag = '3b'").limit(20)
    pairs = t.select(F.col("event_id").alias("tgt_id")).crossJoin(s.select(F.col("event_id").alias("src_id")))
    got = E.event_distance(E.attach(pairs, cr, cr), kind, with_flow=True).toPandas()
    pdf = cr.toPandas().set_index("event_id")
    rows = lambda ids: E.unpack(np.vstack(pdf.loc[ids, "packed"]))
    col = lambda ids, c: pdf.loc[ids, c].to_numpy()
    want, which, turn, _ = E.best_orientation(
        rows(got.src_id), rows(got.tgt_id), FULL, kind, col(got.src_id, "axis"), col(got.tgt_id, "axis"), col(got.src_id, "pz"), col(got.tgt_id, "pz")
    )
    assert len(got) == 400
    assert got.distance.to_numpy() == pytest.approx(want)
    assert (got.orientation.to_numpy() == which).all()


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_by_distance_equal_brute_force(cr, k):
    side = lambda tag: cr.where(F.col("tag") == tag).select(F.col("event_id").alias("id"), F.col("sT").alias("x"))
    measure = lambda p: E.event_distance(E.attach(p, cr, cr), "thrust")
    got = NN.knn_by_distance(side("4b"), side("3b"), k, measure, first_width=4).toPandas()
    t, s = NN.banded(side("4b"), side("3b"))
    t, s = t.toPandas(), s.toPandas()
    pdf = cr.toPandas().set_index("event_id")
    want = {}
    for row in t.itertuples():
        near = s[(s.src_rank >= row.lo) & (s.src_rank < row.hi)]
        ids = near.src_id.to_numpy()
        n = len(ids)
        d = E.best_orientation(
            E.unpack(np.vstack(pdf.loc[ids, "packed"])), E.unpack(np.vstack([pdf.loc[row.tgt_id, "packed"]] * n)), FULL, "thrust",
            pdf.loc[ids, "axis"].to_numpy(), np.full(n, pdf.loc[row.tgt_id, "axis"]), pdf.loc[ids, "pz"].to_numpy(), np.full(n, pdf.loc[row.tgt_id, "pz"]),
        )[0]
        want[row.tgt_id] = np.sort(d)[:k]
    assert set(want) == set(got.tgt_id)
    for tgt, part in got.groupby("tgt_id"):
        assert np.sort(part.distance.to_numpy()) == pytest.approx(want[tgt])


def unit_jets():
    return F.concat(F.array_repeat(F.lit(1.0), 4), F.slice("packed", 5, 8))


@pytest.mark.parametrize("radius,unit", [(FULL, False), (2.75, False), (FULL, True)])
def test_signatures_bound_all_orientations(cr, radius, unit):
    rows = cr.withColumn("packed", unit_jets() if unit else F.col("packed")).select("packed", E.signature(F.col("packed"), radius).alias("s")).limit(120).toPandas()
    pt, _, phi = E.unpack(np.vstack(rows.packed))
    assert np.vstack(rows.s)[:, 6] == pytest.approx(np.abs((pt * np.exp(2j * phi)).sum(1)) / (2 * radius))
    events, marks = np.vstack(rows.packed), np.vstack(rows.s)
    rng = np.random.default_rng(8)
    i, j = rng.integers(0, len(rows), (2, 400))
    least = E.best_orientation(E.unpack(events[i]), E.unpack(events[j]), radius, "full")[0]
    bound = np.abs(marks[i] - marks[j]).max(axis=1)
    assert (bound <= least + 1e-9).all() and (unit or (bound > np.abs(marks[i, 0] - marks[j, 0]) + 1).mean() > 0.3)


@pytest.mark.parametrize("unit", [False, True])
def test_aligned_signatures_bound_the_aligned_distance(cr, unit):
    mark = E.aligned_signature(F.col("packed"), F.col("axis"), F.col("pz"))
    rows = cr.withColumn("packed", unit_jets() if unit else F.col("packed")).select("packed", "axis", "pz", mark.alias("s")).limit(120).toPandas()
    events, marks, axis, pz = np.vstack(rows.packed), np.vstack(rows.s), rows.axis.to_numpy(), rows.pz.to_numpy()
    i, j = np.random.default_rng(8).integers(0, len(rows), (2, 600))
    least = E.best_orientation(E.unpack(events[i]), E.unpack(events[j]), FULL, "thrust", axis[i], axis[j], pz[i], pz[j])[0]
    bound = np.nanmax(np.abs(marks[i] - marks[j]).astype(float), axis=1)
    assert (bound <= least + 1e-9).all()
    apart = least > 0
    assert np.median(bound[apart] / least[apart]) > 0.5
    level = cr.limit(1).select(E.aligned_signature(F.col("packed"), F.col("axis"), F.lit(0.0)).alias("s")).first().s
    assert all(x is not None for x in level[:8]) and all(x is None for x in level[8:])


def test_neighbours_by_bounds_equal_the_search_by_gap(cr):
    side = lambda tag: cr.where(F.col("tag") == tag).select(F.col("event_id").alias("id"), F.col("sT").alias("x"), E.aligned_signature(F.col("packed"), F.col("axis"), F.col("pz")).alias("signature"))
    seen = []

    def measure(pairs):
        seen.append(pairs.count())
        return E.event_distance(E.attach(pairs, cr, cr), "thrust")

    plain = lambda df: df.select("id", "x")
    want = NN.knn_by_distance(plain(side("4b")), plain(side("3b")), 3, lambda p: E.event_distance(E.attach(p, cr, cr), "thrust"), first_width=4).toPandas()
    got = NN.knn_by_bounds(side("4b"), side("3b"), 3, measure).toPandas()
    key = ["tgt_id", "nn"]
    assert len(got) == len(want) > 0
    assert got.sort_values(key).distance.to_numpy() == pytest.approx(want.sort_values(key).distance.to_numpy())
    few = side("3b").limit(2)
    assert NN.knn_by_bounds(side("4b"), few, 3, measure, steps=1).count() == 2 * side("4b").count()
    assert NN.knn_by_bounds(side("4b"), side("3b").where("id < 0"), 3, measure).count() == 0
    # all events alike: a reach of 0
    same = side("3b").withColumn("signature", F.array_repeat(F.lit(1.0), 8)).withColumn("x", F.lit(1.0))
    zero = lambda p: p.withColumn("distance", F.lit(0.0))
    assert NN.knn_by_bounds(same.withColumn("id", -F.col("id")), same, 3, zero).count() == 3 * same.count()


@pytest.mark.parametrize("radius,unit", [(2.75, False), (FULL, True)])
def test_neighbours_in_tiles_equal_the_search_by_gap(spark, cr, radius, unit):
    rows = cr.withColumn("packed", unit_jets() if unit else F.col("packed"))

    def measure(pairs):
        near = E.event_distance(E.attach(pairs, rows, rows), "thrust")
        return near.withColumn("distance", T.radius_change(F.col("distance"), F.col("gap"), radius))

    bare = lambda tag: rows.where(F.col("tag") == tag).select(F.col("event_id").alias("id"), F.col("sT").alias("x"))
    # distances at a smaller radius may lie below the gap, so all of the band is measured
    want = NN.knn_by_distance(bare("4b"), bare("3b"), 3, measure, first_width=1000).toPandas().sort_values(["tgt_id", "nn"])
    tgt, src = DS.signed_sides(rows)
    for tile in ((16, 8), NN.TILE):
        got = NN.knn_in_tiles(tgt, src, 3, E.nearest_in_tile(3, radius), tile=tile).toPandas().sort_values(["tgt_id", "nn"])
        assert len(got) == len(want) > 0
        assert (got.src_id.to_numpy() == want.src_id.to_numpy()).all()
        assert got.distance.to_numpy() == pytest.approx(want.distance.to_numpy())
    few = NN.knn_in_tiles(tgt, src.limit(2), 3, E.nearest_in_tile(3, radius), steps=1)
    assert few.count() == 2 * tgt.count()
    assert NN.knn_in_tiles(tgt, src.where("id < 0"), 3, E.nearest_in_tile(3, radius)).count() == 0


def test_neighbours_in_tiles_measure_few_pairs_and_end_on_nulls(spark, cr):
    tgt, src = DS.signed_sides(cr)
    alike = src.withColumn("x", F.lit(1.0)).crossJoin(spark.range(4).withColumnRenamed("id", "copy")).withColumn("id", F.expr("id * 4 + copy")).drop("copy")
    jets = F.transform("src_packed", lambda x, i: F.when((i != 5) | (F.col("id") % 3 != 0), x))
    lost = alike.withColumn("src_packed", jets).withColumn("src_pz", F.when(F.col("id") % 3 != 0, F.col("src_pz")))
    near = NN.knn_in_tiles(tgt.withColumn("x", F.lit(1.0)), lost, 3, E.nearest_in_tile(3, FULL), steps=1).toPandas()
    assert len(near) == 3 * tgt.count() and np.isfinite(near.distance).all() and (near.src_id % 3 != 0).all()
    unknown = NN.knn_in_tiles(tgt, src.withColumn("src_pz", F.lit(None).cast("double")), 3, E.nearest_in_tile(3, FULL), steps=1).toPandas()
    assert len(unknown) == 3 * tgt.count() and np.isinf(unknown.distance).all()


def test_tile_bounds_never_exceed_the_distance(cr):
    rows = cr.withColumn("signature", E.aligned_signature(F.col("packed"), F.col("axis"), F.col("pz")).cast("array<float>")).limit(200)
    table = rows.select(F.col("event_id").alias("s_id"), F.col("sT").alias("s_x"), *[F.col(c).alias(f"s_{c}") for c in ("packed", "axis", "pz", "signature")]).toArrow()
    e = E._Events(table, "s")
    i, j = np.random.default_rng(5).integers(0, table.num_rows, (2, 2000))
    bound = E._least_cost(e, e, i, j, FULL)
    least = E.best_orientation(E.unpack(e.packed[i]), E.unpack(e.packed[j]), FULL, "thrust", e.axis[i], e.axis[j], e.pz[i], e.pz[j])[0]
    assert (bound - e.error[i] - e.error[j] <= least).all()
    assert np.median(bound[least > 0] / least[least > 0]) > 0.8


def test_proofs_hold_few_orientations_at_a_time(cr, monkeypatch):
    sizes = cr.sparkSession.sparkContext.accumulator(0)
    whole = E.best_orientation

    def counted(a, *args, **options):
        sizes.add(1 if len(a[0]) > 2 else 0)
        return whole(a, *args, **options)

    monkeypatch.setattr(E, "_TRIES", 120)
    monkeypatch.setattr(E, "best_orientation", counted)
    side = lambda p: cr.select(F.col("event_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("packed", "axis", "pz")])
    pairs = side("src").limit(7).crossJoin(side("tgt").limit(3)).coalesce(1)
    out = PR.proven(pairs, "full").toPandas()
    assert len(out) == 21 and out.flow_holds.all() and out.nothing_cheaper.all()
    assert sizes.value == 0


def test_hot_value_neighbours(spark):
    """A third of the sources share one x: ties are settled and nobody is dropped."""
    src = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") / 3.0).alias("x"))
    tgt = spark.range(90).select((F.col("id") + 1000).alias("id"), F.when(F.col("id") % 3 == 0, 50.0).otherwise(F.col("id") * 1.0).alias("x"))
    got = NN.knn_by_gap(tgt, src, 3, steps=5).toPandas()
    t, s = (x.toPandas() for x in NN.banded(tgt, src, 5))
    for row in t.itertuples():
        near = s[(s.src_rank >= row.lo) & (s.src_rank < row.hi)]
        want = np.sort(np.abs(near.src_x - row.tgt_x))[:3]
        assert np.sort(got[got.tgt_id == row.tgt_id].distance) == pytest.approx(want)
    shares = NN.inverse_distance_shares(NN.knn_by_gap(tgt, src, 3, steps=5)).groupBy("tgt_id").agg(F.sum("share").alias("s"))
    assert shares.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def _sides(spark, n, m, blocks=2):
    rng = np.random.default_rng(9)
    make = lambda size, base: spark.createDataFrame(
        [(b, base + b * size + i, float(x), float(w)) for b in range(blocks) for i, (x, w) in enumerate(zip(rng.uniform(0, 10, size), rng.uniform(0.1, 1, size)))],
        "block long, id long, x double, w double",
    )
    return make(n, 0), make(m, 10000)


def test_monotone_coupling_is_optimal(spark):
    s, t = _sides(spark, 30, 23)
    c = T.monotone_coupling(s, t).toPandas()
    ps, pt = s.toPandas(), t.toPandas()
    for b in (0, 1):
        x, y = ps[ps.block == b], pt[pt.block == b]
        # in one dimension the least cost is the area between the two cumulative distributions
        at = np.sort(np.concatenate([x.x, y.x]))
        below = lambda p: np.array([p.w[p.x <= v].sum() / p.w.sum() for v in at[:-1]])
        least = (np.abs(below(x) - below(y)) * np.diff(at)).sum()
        part = c[c.block == b].merge(x[["id", "x"]], left_on="src_id", right_on="id").merge(y[["id", "x"]], left_on="tgt_id", right_on="id")
        assert (part.value * (part.x_x - part.x_y).abs()).sum() == pytest.approx(least, rel=1e-5)
        src = part.groupby("src_id").value.sum()
        assert src.to_numpy() == pytest.approx((x.set_index("id").w / x.w.sum()).loc[src.index].to_numpy(), rel=1e-4)


def test_whole_coupling_equals_block_coupling(spark):
    s, t = _sides(spark, 40, 31, blocks=1)
    a = T.monotone_coupling(s, t).toPandas().set_index(["src_id", "tgt_id"]).value
    b = T.monotone_coupling_whole(s.drop("block"), t.drop("block")).toPandas().set_index(["src_id", "tgt_id"]).value
    assert set(a.index) == set(b.index)
    assert a.to_numpy() == pytest.approx(b.loc[a.index].to_numpy())


def test_one_source_with_a_third_of_the_mass(spark):
    s, t = _sides(spark, 20, 50, blocks=1)
    s = s.withColumn("w", F.when(F.col("id") == 3, 6.0).otherwise(F.col("w")))
    c = T.monotone_coupling_whole(s.drop("block"), t.drop("block"))
    assert c.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    assert c.where("src_id = 3").count() > 10


def test_gap_moments_equal_all_pairs(spark):
    s, t = _sides(spark, 17, 12)
    got = {r["block"]: r for r in gap_moments(s, t).collect()}
    ps, pt = s.toPandas(), t.toPandas()
    for b in (0, 1):
        gaps = np.abs(ps[ps.block == b].x.to_numpy()[:, None] - pt[pt.block == b].x.to_numpy()[None])
        assert got[b]["n_pairs"] == gaps.size
        assert got[b]["mean_gap"] == pytest.approx(gaps.mean())
        assert got[b]["mean_square"] == pytest.approx((gaps ** 2).mean())


def test_couplings_refuse_negative_weights(spark):
    s, t = _sides(spark, 5, 4, blocks=1)
    s = s.withColumn("w", F.when(F.col("id") == 3, -1.0).otherwise(F.col("w")))
    for run in (lambda: T.monotone_coupling(s, t), lambda: T.monotone_coupling_whole(s.drop("block"), t.drop("block"))):
        with pytest.raises(Exception, match="not negative"):
            run().count()


def test_couplings_keep_small_cells(spark):
    """Equal weights in different numbers: every cell has mass, down to the smallest."""
    n, m = 401, 400
    make = lambda size, base: spark.range(size).select(F.lit(0).alias("block"), (F.col("id") + base).alias("id"), F.col("id").cast("double").alias("x"), F.lit(1e-6).alias("w"))
    c = T.monotone_coupling(make(n, 0), make(m, 1000))
    assert c.count() == n + m - 1 and c.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    assert c.agg(F.min("value")).first()[0] == pytest.approx(1 / (n * m))


def test_couplings_keep_light_rows(spark):
    """Weights that sum to 1 over ten million rows' scale, next to one that outweighs them a million times."""
    n, m = 301, 300
    make = lambda size, base: spark.range(size).select(F.lit(0).alias("block"), (F.col("id") + base).alias("id"), F.col("id").cast("double").alias("x"), F.lit(1e-7).alias("w"))
    c = T.monotone_coupling(make(n, 0), make(m, 1000))
    assert c.count() == n + m - 1 and c.agg(F.min("value")).first()[0] == pytest.approx(1 / (n * m))
    heavy = make(n, 0).withColumn("w", F.when(F.col("id") == 7, 0.1).otherwise(F.when(F.col("id") == 8, 1e-300).otherwise(F.col("w"))))
    mass = {r.src_id: r.mass for r in T.marginals(T.monotone_coupling(heavy, make(m, 1000)), "src_id").collect()}
    total = 0.1 + (n - 2) * 1e-7
    assert len(mass) == n and mass[7] == pytest.approx(0.1 / total) and mass[9] == pytest.approx(1e-7 / total, rel=1e-6) and mass[8] > 0


def test_block_with_one_target(spark):
    """A block with very many sources and one target, next to small ones and one without targets."""
    s = spark.range(20_000).select(F.when(F.col("id") < 19_990, 0).otherwise(F.col("id") % 3).alias("block"), "id", (F.col("id") % 97).cast("double").alias("x"), F.lit(0.5).alias("w"))
    t = spark.createDataFrame([(0, 100_000, 3.0, 2.0), (1, 100_001, 1.0, 1.0), (1, 100_002, 2.0, 1.0)], "block int, id long, x double, w double")
    c = T.monotone_coupling(s, t)
    by = {r.block: (r.n, r.v) for r in c.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).collect()}
    assert set(by) == {0, 1} and by[0][0] == s.where("block = 0").count()
    assert all(v == pytest.approx(1.0) for _, v in by.values())
