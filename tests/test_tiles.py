"""The search of nearest events in tiles: what it leaves out and that nothing is lost by it."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagshift.catalog import distances as DS
from tagshift.operators import emd as E
from tagshift.operators import neighbours as NN
from tagshift.operators import proofs as PR
from tagshift.sources import fixtures as fx

FULL = 2 * math.pi


@pytest.fixture(scope="module")
def cr(spark, sf_dir):
    e = E.with_alignment(fx.events(spark, sf_dir).where("region = 'CR'")).select("event_id", "tag", F.lit("CR").alias("region"), "sT", "packed", "axis", "pz")
    return e.cache()


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    packed = np.hstack([rng.uniform(30, 230, (n, 4)), (rng.integers(0, 11, (n, 4)) - 5) / 2, rng.uniform(-math.pi, math.pi, (n, 4))])
    return packed, rng.uniform(-math.pi / 2, math.pi / 2, n), rng.normal(0, 100, n)


def side(name, packed, axis, pz, **more):
    ends = pa.array(np.arange(0, 12 * len(packed) + 1, 12), pa.int32())
    return pa.table({
        f"{name}_id": np.arange(len(packed)), f"{name}_x": packed[:, :4].sum(axis=1), f"{name}_packed": pa.ListArray.from_arrays(ends, pa.array(packed.ravel())),
        f"{name}_axis": axis, f"{name}_pz": pz, f"{name}_signature": pa.array([[1.0] * 38] * len(packed), pa.list_(pa.float32())), **more})


def asking(packed, axis, pz, n_src, centre):
    n = len(packed)
    return side("tgt", packed, axis, pz, lo=np.zeros(n, int), hi=np.full(n, n_src), centre=np.asarray(centre), reach=np.full(n, np.inf), edge=np.full(n, np.inf),
                seen_lo=np.zeros(n, int), seen_hi=np.zeros(n, int))


def test_copies_of_an_event_are_not_all_measured(monkeypatch):
    """Of sources at one distance those next in order count, so the others need no distance."""
    packed, axis, pz = (np.repeat(x, 300, axis=0) for x in random_rows(6, 1))
    src = side("src", packed, axis, pz, src_rank=np.arange(1800))
    tgt = asking(packed[::300], axis[::300], pz[::300], 1800, np.arange(6) * 300 + 150)
    solved, whole = [], E.transport_cost
    monkeypatch.setattr(E, "transport_cost", lambda a, *args, **options: (solved.append(len(a[0])), whole(a, *args, **options))[1])
    got = E.nearest_in_tile(3, 2.75)(tgt, src).sort_by([("tgt_id", "ascending"), ("src_rank", "ascending")])
    assert got["distance"].to_numpy() == pytest.approx(np.zeros(18))
    assert (got["src_rank"].to_numpy().reshape(6, 3) - 300 * np.arange(6)[:, None] == [148, 149, 150]).all()
    assert sum(solved) < 6 * 300


@pytest.mark.parametrize("radius", [2.75, FULL])
def test_search_equals_all_pairs(radius):
    (sp, sa, sz), (tp, ta, tz) = random_rows(700, 2), random_rows(300, 3)
    sz[:5] = 0.0
    tz[:2] = 0.0
    tp[:40], ta[:40], tz[:40] = sp[:40], sa[:40], sz[:40]
    order = np.argsort(sp[:, :4].sum(axis=1), kind="stable")
    sp, sa, sz = sp[order], sa[order], sz[order]
    got = E.nearest_in_tile(4, radius)(asking(tp, ta, tz, 700, np.searchsorted(sp[:, :4].sum(axis=1), tp[:, :4].sum(axis=1))), side("src", sp, sa, sz, src_rank=np.arange(700)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(700), indexing="ij"))
    value = E.best_orientation(E.unpack(sp[j]), E.unpack(tp[i]), FULL, "thrust", sa[j], ta[i], sz[j], tz[i])[0].reshape(300, 700)
    gap = np.abs(tp[:, None, :4].sum(axis=2) - sp[None, :, :4].sum(axis=2))
    want = np.sort(FULL / radius * value + (radius - FULL) / radius * gap, axis=1)[:, :4]
    found = np.full((300, 4), np.nan)
    by = np.lexsort((got["distance"].to_numpy(), got["tgt_id"].to_numpy()))
    found[:] = got["distance"].to_numpy()[by].reshape(300, 4)
    assert found == pytest.approx(want, abs=1e-6)


def test_bytes_lose_no_pair_within_room():
    rng = np.random.default_rng(4)
    marks, wanted = rng.uniform(-500, 500, (300, 5)), rng.uniform(-500, 500, (200, 5))
    wanted[:50] = marks[:50] + rng.uniform(-2, 2, (50, 5))
    marks[7, 1] = wanted[9, 3] = np.nan
    room = rng.uniform(0, 300, 200)
    near = E._Grid(marks, wanted, room).near()
    within = np.nanmax(np.abs(wanted[:, None] - marks), axis=2) <= room[:, None]
    assert (near | ~within).all() and within.any() and near.sum() < 2 * within.sum() + 2000


def test_marks_equal_the_signature(cr):
    rows = cr.select("packed", "axis", F.when(F.col("event_id") % 5 > 0, F.col("pz")).otherwise(0.0).alias("pz")).withColumn(
        "s", E.aligned_signature(F.col("packed"), F.col("axis"), F.col("pz"))).limit(80).toPandas()
    got = E.aligned_marks(np.vstack(rows.packed), rows.axis.to_numpy(), rows.pz.to_numpy())
    assert got == pytest.approx(np.vstack(rows.s).astype(float), nan_ok=True)


def test_lots_and_ceilings_change_no_distance_in_reach(monkeypatch):
    a, b = (E.unpack(random_rows(500, s)[0]) for s in (5, 6))
    whole, flow = E.transport_cost(a, b, FULL)
    most = np.random.default_rng(7).uniform(0, 300, 500)
    monkeypatch.setattr(E, "_LOT", 64)
    capped = E.transport_cost(a, b, FULL, most=most)[0]
    assert (capped[whole <= most] == whole[whole <= most]).all()
    above = whole > most
    assert (np.isinf(capped[above]) | (capped[above] == whole[above])).all() and np.isinf(capped[above]).mean() > 0.9
    assert E.transport_cost(a, b, FULL)[0] == pytest.approx(whole) and flow.min() >= 0


@pytest.mark.parametrize("wider", [(1, 1), (2, 3)])
def test_wider_tiles_find_the_same(cr, wider):
    tgt, src = DS.signed_sides(cr)
    # copies on both sides of the edges of tiles
    src = src.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(5)]))).withColumn("id", F.col("id") * 5 + F.col("copy")).drop("copy")
    want = NN.knn_in_tiles(tgt, src, 3, E.nearest_in_tile(3, 2.75)).toPandas().sort_values(["tgt_id", "nn"])
    got = NN.knn_in_tiles(tgt, src, 3, E.nearest_in_tile(3, 2.75), tile=(16, 8), wider=wider, by_gap=True).toPandas().sort_values(["tgt_id", "nn"])
    assert len(got) == 3 * tgt.count()
    assert (got.src_id.to_numpy() == want.src_id.to_numpy()).all()
    assert got.distance.to_numpy() == pytest.approx(want.distance.to_numpy())


@pytest.mark.parametrize("steps", [101, 103])
def test_scanned_turns_equal_each_by_itself(steps):
    """Flows taken over from the turn beside are proven or solved again, so each turn has its own least cost and prices."""
    a, b = (E.unpack(random_rows(30, s)[0]) for s in (8, 9))
    b = tuple(np.vstack([y[:25], x[25:]]) for x, y in zip(a, b))
    best, which, turn, flow, prices = E.best_orientation(a, b, FULL, "full", steps=steps, proof=True)
    tried = E.variants("full", steps)
    diff = a[0].sum(1) - b[0].sum(1)
    masses = np.hstack([a[0], np.maximum(-diff, 0)[:, None], b[0], np.maximum(diff, 0)[:, None]])
    values = []
    for n, (flip_eta, flip_phi, by) in enumerate(tried):
        turned = a[0], -a[1] if flip_eta else a[1], (-a[2] if flip_phi else a[2]) + by
        values.append(E.transport_cost(turned, b, FULL)[0])
        assert (masses * prices[:, n]).sum(1) == pytest.approx(values[-1])
    assert best == pytest.approx(np.min(values, axis=0), abs=1e-8)
    assert np.array(values)[which, np.arange(30)] == pytest.approx(best)
    assert flow.sum(axis=(1, 2)) == pytest.approx(np.minimum(a[0].sum(1), b[0].sum(1)))


def test_many_turns_take_few_calls(monkeypatch):
    """The kernel is not called for each orientation of a few pairs."""
    a, b = (E.unpack(random_rows(3, s)[0]) for s in (10, 11))
    calls, whole = [], E.transport_cost
    monkeypatch.setattr(E, "transport_cost", lambda *args, **options: (calls.append(1), whole(*args, **options))[1])
    E.best_orientation(a, b, FULL, "full", steps=101)
    assert len(calls) < 10


def test_kernel_runs_once_for_a_proof(cr):
    side = lambda p: cr.select(F.col("event_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("packed", "axis", "pz")])
    pairs = side("src").limit(4).crossJoin(side("tgt").limit(4))
    proven = PR.proven(pairs, "eta_flip")
    assert proven._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = proven.collect()
    assert len(rows) == 16 and all(r.flow_holds and r.nothing_cheaper for r in rows)


@pytest.mark.parametrize("radius", [0.4, FULL])
def test_turns_that_cost_more_are_not_solved(monkeypatch, radius):
    """Of the four turns of an aligned distance those are solved that may be the least; the result is that of all four."""
    (ap, ax, az), (bp, bx, bz) = random_rows(400, 12), random_rows(400, 13)
    bp[:50], bx[:50], bz[:50] = ap[:50], ax[:50], az[:50]
    a, b = E.unpack(ap), E.unpack(bp)
    want = E.best_orientation(a, b, radius, "thrust", ax, bx, az, bz, proof=True)
    solved, whole = [], E._augment
    monkeypatch.setattr(E, "_augment", lambda supply, *args: (solved.append(supply.shape[1]), whole(supply, *args))[1])
    E.best_orientation(a, b, radius, "thrust", ax, bx, az, bz, proof=True)
    full = sum(solved)
    solved.clear()
    got = E.best_orientation(a, b, radius, "thrust", ax, bx, az, bz)
    assert sum(solved) < 0.8 * full
    assert got[0] == pytest.approx(want[0], abs=1e-9) and (got[1] == want[1]).all() and got[2] == pytest.approx(want[2])
    assert got[3].sum(axis=(1, 2)) == pytest.approx(want[3].sum(axis=(1, 2)))
