"""Distance between four-jet events: moving transverse momentum over (eta, phi), Arrow batch by batch.

The distance is the cheapest way to turn one event into the other, where moving pt costs the
(eta, phi) distance over R and creating or removing pt costs 1 (Komiske, Metodiev and Thaler,
arXiv:1902.02346). Spark forms and shuffles the pairs; a task only sees Arrow batches of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.constants import BASE_RADIUS
from tagshift.functions.jets import longitudinal_sum
from tagshift.functions.thrust import thrust

_EPS = 1e-11
Event = tuple[np.ndarray, np.ndarray, np.ndarray]  # pt, eta, phi, each (rows, 4)


def packed(jets: Column) -> Column:
    """ARRAY<DOUBLE> of 12: four pt, four eta, four phi."""
    return F.array(*[jets[i][c] for c in ("pt", "eta", "phi") for i in range(4)])


def with_alignment(df: DataFrame, jets: str = "jets") -> DataFrame:
    """Adds what the aligned distance needs of one event: packed jets, thrust axis, longitudinal sum.

    Computed once per event, before any pair is formed.
    """
    j = F.col(jets)
    return df.select(
        "*", packed(j).alias("packed"), thrust(j)["phi"].alias("axis"), longitudinal_sum(j).alias("pz")
    )


def signature(packed_jets: Column, radius: float = BASE_RADIUS) -> Column:
    """Numbers of an event that differ between two events by no more than their distance at ``radius``, whatever the orientation.

    A sum of pt times a function of the place changes by no more than the distance if the function changes by no
    more than the place does over the radius and never exceeds 1, as creating pt costs 1. Functions of abs(eta) alone do not see
    flips and rotations; of waves in phi, the modulus does not. The first number is the sum of pt, the second and third tell
    central from forward events.
    """
    part = lambda k, f: F.transform(F.slice(packed_jets, 4 * k + 1, 4), f)
    total = lambda weights: F.aggregate(F.zip_with(part(0, lambda x: x), weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    far = min(0.4, 2.5 / radius)
    out = lambda x: F.least(F.abs(x) / radius, F.lit(far))
    by_eta = [lambda x: F.lit(1.0), lambda x: 1 - out(x), lambda x: 1 - far + out(x), lambda x: 1 - F.abs(out(x) - far / 2), lambda x: 1 - far / 2 + F.abs(out(x) - far / 2)]

    def wave(k: int) -> Column:
        # a second parameter of a function of elements would be their index
        across, up = total(part(2, lambda x: F.cos(k * x))), total(part(2, lambda x: F.sin(k * x)))
        return F.hypot(across, up) / max(1.0, k * radius)

    return F.array(*[total(part(1, f)) for f in by_eta], *[wave(k) for k in (1, 2, 3)])


#: places (eta, phi from the thrust axis) from which the aligned signature measures
_POSTS = [(eta, phi) for eta in (-2.5, -1.25, 0.0, 1.25, 2.5) for phi in (0.0, math.pi / 4, math.pi / 2)]


def aligned_signature(packed_jets: Column, axis: Column, pz: Column, radius: float = BASE_RADIUS) -> Column:
    """``signature`` and further numbers that only hold for the distance of kind "thrust".

    That distance turns events onto their thrust axes, by half turns and flips, and to one side in eta. Folded
    by the same moves, places come no further apart, so how far pt lies from a few posts bounds the distance too. An event
    of no longitudinal sum is not turned to a side; its further numbers are null.
    """
    side = F.when(pz > 0, 1.0).when(pz < 0, -1.0)
    places = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(
        F.element_at(packed_jets, i).alias("pt"), (F.element_at(packed_jets, i + 4) * side).alias("eta"),
        F.abs(F.pmod(F.element_at(packed_jets, i + 8) - axis + math.pi / 2, F.lit(math.pi)) - math.pi / 2).alias("phi")))
    total = lambda f: F.aggregate(places, F.lit(0.0), lambda a, x: a + x["pt"] * f(x))
    posts = F.array(*[F.struct(F.lit(e).alias("eta"), F.lit(p).alias("phi")) for e, p in _POSTS])
    # the least of a null and a number would be the number
    away = lambda x, post: F.when(side.isNotNull(), F.least(F.hypot(x["eta"] - post["eta"], x["phi"] - post["phi"]) / radius, F.lit(0.85)))
    near = F.flatten(F.transform(posts, lambda post: F.array(total(lambda x: 1 - away(x, post)), total(lambda x: 0.15 + away(x, post)))))
    return F.concat(signature(packed_jets, radius), near)


def aligned_marks(rows: np.ndarray, axis: np.ndarray, pz: np.ndarray, radius: float = BASE_RADIUS) -> np.ndarray:
    """``aligned_signature`` of a batch of packed events, one row each; what is not known is NaN."""
    pt, eta, phi = unpack(rows)
    far = min(0.4, 2.5 / radius)
    out = np.minimum(np.abs(eta) / radius, far)
    plain = [pt, pt * (1 - out), pt * (1 - far + out), pt * (1 - np.abs(out - far / 2)), pt * (1 - far / 2 + np.abs(out - far / 2))]
    waves = [np.hypot((pt * np.cos(k * phi)).sum(axis=1), (pt * np.sin(k * phi)).sum(axis=1)) / max(1.0, k * radius) for k in (1, 2, 3)]
    side = np.where(pz > 0, 1.0, np.where(pz < 0, -1.0, np.nan))[:, None]
    eta, phi = eta * side, np.abs((phi - axis[:, None] + math.pi / 2) % math.pi - math.pi / 2)
    near = []
    for post_eta, post_phi in _POSTS:
        away = np.minimum(np.hypot(eta - post_eta, phi - post_phi) / radius, 0.85)
        near += [(pt * (1 - away)).sum(axis=1), (pt * (0.15 + away)).sum(axis=1)]
    return np.column_stack([*[x.sum(axis=1) for x in plain], *waves, *near])


def unpack(rows: np.ndarray) -> Event:
    return rows[:, 0:4], rows[:, 4:8], rows[:, 8:12]


_LOT = 1 << 12  # pairs solved together, whose costs stay in a core's cache


def transport_cost(a: Event, b: Event, radius: float, proof: bool = False, most: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distances and 4 x 4 flows of a batch of event pairs; with ``proof`` also ten potentials each.

    Of a pair that prices put above ``most``, the distance is given as infinite.

    A fifth place on each side takes the difference in total pt. The 5 x 5 problems of a lot
    advance together, batch axis last: what can move at the least cost of its source, then of its target, moves first. From then on each
    round finds every pair's cheapest augmenting path and fills it; pairs that are done leave the lot. Events that are not known in full are at no distance.
    """
    part = lambda x, s: None if x is None else x[s:s + _LOT]
    lots = [_transport_lot(tuple(part(x, s) for x in a), tuple(part(x, s) for x in b), radius, proof, part(most, s)) for s in range(0, max(len(a[0]), 1), _LOT)]
    return lots[0] if len(lots) == 1 else tuple(np.concatenate(x) for x in zip(*lots))


def _problem(a: Event, b: Event, radius: float) -> tuple[np.ndarray, ...]:
    """Supply, demand and cost of the five places of either side; where an event is not known in full, nothing is to be moved."""
    rows = len(a[0])
    diff = a[0].sum(axis=1) - b[0].sum(axis=1)
    supply = np.vstack([a[0].T, np.maximum(-diff, 0.0)])
    demand = np.vstack([b[0].T, np.maximum(diff, 0.0)])
    deta = a[1].T[:, None] - b[1].T[None]
    dphi = np.abs(a[2].T[:, None] - b[2].T[None]) % (2 * math.pi)
    dphi = np.minimum(dphi, 2 * math.pi - dphi)
    cost = np.ones((5, 5, rows))
    cost[:4, :4] = np.sqrt(deta * deta + dphi * dphi) / radius
    cost[4, 4] = 0.0
    lost = ~np.isfinite(cost.sum(axis=(0, 1)) + diff)
    supply[:, lost] = demand[:, lost] = 0.0
    return supply, demand, cost, lost


def _transport_lot(a: Event, b: Event, radius: float, proof: bool, most: np.ndarray | None) -> tuple[np.ndarray, ...]:
    rows = len(a[0])
    supply, demand, cost, lost = _problem(a, b, radius)
    full_cost, full_flow = cost, np.zeros((5, 5, rows))
    tol = _EPS * np.maximum(supply.sum(axis=0), 1.0)
    live, flow = np.arange(rows), np.zeros((5, 5, rows))
    all_supply, all_demand, beyond = supply.copy(), demand.copy(), np.zeros(rows, bool)
    near, far = _move_cheapest(supply, demand, cost, flow)
    while len(live):
        active = (supply.max(axis=0) > tol) & (demand.max(axis=0) > tol)
        if most is not None:
            worth = (all_demand[:, live] * far).sum(axis=0) - (all_supply[:, live] * near).sum(axis=0)
            beyond[live] = worth > most[live]
            active &= ~beyond[live]
        if not active.all():
            full_flow[:, :, live[~active]] = flow[:, :, ~active]
            live, tol = live[active], tol[active]
            supply, demand, cost, flow = supply[:, active], demand[:, active], cost[:, :, active], flow[:, :, active]
            if not len(live):
                break
        near, far = _augment(supply, demand, cost, flow, tol)
    value = (full_flow * full_cost).sum(axis=(0, 1))
    value[lost], value[beyond] = np.nan, np.inf
    out = value, np.moveaxis(full_flow[:4, :4], 2, 0)
    return (*out, _potentials(full_cost, full_flow)) if proof else out


def _move_cheapest(supply, demand, cost, flow) -> tuple[np.ndarray, np.ndarray]:
    """Moves what the prices "least cost of a source, then least remainder of a target" allow; returns these as ``_augment`` does.

    Mass moves only where the prices add up to the cost, so it is a cheapest flow of what moves and can be augmented.
    """
    least = cost.min(axis=1)
    rest = cost - least[:, None]
    _move(supply, demand, flow, rest <= 0)
    left = rest.min(axis=0)
    _move(supply, demand, flow, rest <= left)
    return -least, left


def _move(supply, demand, flow, tight) -> None:
    for i in range(5):
        for j in range(5):
            amount = np.minimum(supply[i], demand[j])
            amount *= tight[i, j]
            supply[i] -= amount
            demand[j] -= amount
            flow[i, j] += amount


def _potentials(cost: np.ndarray, flow: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Prices of the five places of either side, whose sums never exceed the cost and reach it where mass moves.

    They are shortest distances in what the flow leaves open, so they exist for a cheapest flow only; of another one they do not reach it.
    """
    back = np.where(flow > _EPS * np.maximum(flow.sum(axis=(0, 1)), 1.0), 0.0, np.inf) - cost
    near = np.zeros(cost.shape[1:])
    for _ in range(rounds):
        far = (near[:, None] + cost).min(axis=0)
        shorter = np.minimum(near, (far[None] + back).min(axis=1))
        if (shorter == near).all():
            break
        near = shorter
    return np.vstack([-near, (near[:, None] + cost).min(axis=0)]).T


def _augment(supply, demand, cost, flow, tol) -> tuple[np.ndarray, np.ndarray]:
    """One cheapest augmenting path for every pair of the batch, after all single moves that cost as little; returns what it costs to reach the places.

    ``near[n]`` and ``far[n]`` are the costs to the sources and targets over at most n returns. A place is traced back from
    the first n at which it has its cost, so no path goes in a circle that costs nothing.
    """
    k = np.arange(supply.shape[1])
    back = np.where(flow > tol, -cost, np.inf)
    near, far = [np.where(supply > tol, 0.0, np.inf)], []
    while True:
        out = near[-1][0] + cost[0]
        for i in range(1, 5):
            np.minimum(out, near[-1][i] + cost[i], out=out)
        far.append(out)
        ret = out[0] + back[:, 0]
        for j in range(1, 5):
            np.minimum(ret, out[j] + back[:, j], out=ret)
        shorter = ret < near[-1] - _EPS
        if len(far) == 5 or not shorter.any():
            break
        near.append(np.where(shorter, ret, near[-1]))
    _move(supply, demand, flow, (near[-1][:, None] + cost <= far[-1]) & (near[0] == 0)[:, None])
    end = np.where(demand > tol, far[-1], np.inf).argmin(axis=0)
    amount = np.where(supply.max(axis=0) > tol, demand[end, k], 0.0)
    near, far = np.stack(near), np.stack(far)
    steps, j, on, level = [], end, k, np.full(len(k), len(far) - 1)
    while len(on):
        level = np.minimum(level, (far[:, j, on] <= far[level, j, on] + _EPS).argmax(axis=0))
        i = (near[level, :, on].T + cost[:, j, on]).argmin(axis=0)
        level = (near[:, i, on] <= near[level, i, on]).argmax(axis=0)
        inner = level > 0
        before, prev = np.maximum(level - 1, 0), np.zeros(len(on), int)
        prev[inner] = (far[before[inner], :, on[inner]] + back[i[inner], :, on[inner]]).argmin(axis=1)
        steps.append((on, i, j, inner, prev))
        amount[on] = np.minimum(amount[on], np.where(inner, flow[i, prev, on], supply[i, on]))
        on, j, level = on[inner], prev[inner], before[inner]
    for on, i, j, inner, prev in steps:
        flow[i, j, on] += amount[on]
        flow[i[inner], prev[inner], on[inner]] -= amount[on[inner]]
        first = on[~inner]
        supply[i[~inner], first] -= amount[first]
    demand[end, k] -= amount
    return np.where(np.isfinite(near[-1]), near[-1], 0.0), far[-1]


def variants(kind: str, steps: int = 15) -> list[tuple[bool, bool, float]]:
    """(flip eta, flip phi, rotation) of the first event for the scanning searches."""
    turns = [2 * math.pi * i / (steps - 1) for i in range(steps - 1)]
    return {
        "nominal": [(False, False, 0.0)],
        "eta_flip": [(False, False, 0.0), (True, False, 0.0)],
        "phi_rotation": [(False, False, r) for r in turns],
        "full": [(e, p, r) for p in (False, True) for e in (False, True) for r in turns],
    }[kind]


def _anchors(kind: str, steps: int) -> np.ndarray | None:
    """For each of the ``variants``, the one of the same flips, at most two turns aside, whose flow is tried first; None where turns lie far apart."""
    if kind not in ("phi_rotation", "full") or steps <= 50:
        return None
    number = np.arange(len(variants(kind, steps)))
    turn = number % (steps - 1)
    beside = (turn + 2) // 4 * 4
    return number - turn + np.where(beside < steps - 1, beside, 0)


def _turned_costs(
    pt: np.ndarray, tries: list[tuple[np.ndarray, np.ndarray]], b: Event, radius: float, proof: bool, anchors: np.ndarray | None
) -> Iterator[tuple[np.ndarray, ...]]:
    """``transport_cost`` of the pairs for each of the tries (eta, phi) of their first events.

    Many problems are solved at once, as few rows are no work for an array. With ``anchors`` only those are solved from nothing; where their flow
    has prices that prove it for the tries beside them too, it is taken.
    """
    rows = len(pt)

    if anchors is None or not rows:
        # tries next to each other together
        group = max(1, _LOT // max(rows, 1))
        for first in range(0, len(tries), group):
            some = tries[first:first + group]
            a = tuple(np.concatenate(x) for x in ([pt] * len(some), [e for e, _ in some], [p for _, p in some]))
            out = transport_cost(a, tuple(np.concatenate([x] * len(some)) for x in b), radius, proof)
            for n in range(len(some)):
                yield tuple(x[n * rows:(n + 1) * rows] for x in out)
        return

    shape, (etas, phis) = (len(tries), rows), (np.stack(x) for x in zip(*tries))

    def stacked(numbers: np.ndarray, pairs: np.ndarray) -> tuple[Event, Event]:
        """Problems by number of the try and pair."""
        return (pt[pairs], etas[numbers, pairs], phis[numbers, pairs]), tuple(x[pairs] for x in b)

    value, flow, prices = np.empty(shape), np.empty((*shape, 4, 4)), np.empty((*shape, 10))

    def solve(numbers: np.ndarray, pairs: np.ndarray) -> None:
        for s in range(0, len(numbers), _LOT):
            at = numbers[s:s + _LOT], pairs[s:s + _LOT]
            value[at], flow[at], prices[at] = transport_cost(*stacked(*at), radius, True)

    each = np.arange(rows)
    fixed = np.unique(anchors)
    solve(np.repeat(fixed, rows), np.tile(each, len(fixed)))
    others = np.flatnonzero(anchors != np.arange(len(tries)))
    numbers, pairs, again = np.repeat(others, rows), np.tile(each, len(others)), []
    for s in range(0, len(numbers), _LOT):
        at = numbers[s:s + _LOT], pairs[s:s + _LOT]
        supply, demand, cost, lost = _problem(*stacked(*at), radius)
        moved = np.zeros_like(cost)
        moved[:4, :4] = np.moveaxis(flow[anchors[at[0]], at[1]], 0, 2)
        # what is left over goes to the fifth places
        moved[:4, 4], moved[4, :4] = (np.maximum(x, 0) for x in ((supply[:4] - moved[:4, :4].sum(axis=1)) * (demand[4] > 0), (demand[:4] - moved[:4, :4].sum(axis=0)) * (supply[4] > 0)))
        price, paid = _potentials(cost, moved, 6), (moved * cost).sum(axis=(0, 1))
        worth = (price.T[:5] * supply).sum(axis=0) + (price.T[5:] * demand).sum(axis=0)
        proven = ~lost & (np.abs(worth - paid) <= _EPS * np.maximum(supply.sum(axis=0), 1.0))
        value[at], flow[at], prices[at] = paid, flow[anchors[at[0]], at[1]], price
        again.append(s + np.flatnonzero(~proven))
    again = np.concatenate(again)
    solve(numbers[again], pairs[again])
    for n in range(len(tries)):
        yield (value[n], flow[n], prices[n]) if proof else (value[n], flow[n])


def _hopeful_costs(pt: np.ndarray, tries: list[tuple[np.ndarray, np.ndarray]], b: Event, radius: float, least: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``transport_cost`` of the pairs for each of the tries, infinite for those that cost more than another one, known from what they cost at ``least``."""
    rows = len(pt)
    value, flow, (etas, phis) = np.full((len(tries), rows), np.inf), np.zeros((len(tries), rows, 4, 4)), (np.stack(x) for x in zip(*tries))

    def solve(number: np.ndarray, pair: np.ndarray, most: np.ndarray | None) -> None:
        for s in range(0, len(pair), _LOT):
            n, at = number[s:s + _LOT], pair[s:s + _LOT]
            # at least two rows, as one alone may be added up in another order
            n_, at_ = (np.append(x, x[:1]) if len(x) == 1 else x for x in (n, at))
            ceiling = None if most is None else most[at_]
            out = transport_cost((pt[at_], etas[n_, at_], phis[n_, at_]), tuple(x[at_] for x in b), radius, most=ceiling)
            value[n, at], flow[n, at] = out[0][: len(at)], out[1][: len(at)]

    first = np.where(np.isnan(least), np.inf, least).argmin(axis=0)
    solve(first, np.arange(rows), None)
    # more than what differences in rounding can change
    most = value[first, np.arange(rows)]
    most = most + 1e-8 * np.maximum(1.0, most)
    number, pair = np.nonzero(~(least > most) & (np.arange(len(tries))[:, None] != first))
    solve(number, pair, most)
    yield from zip(value, flow)


def _turned(phi: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Azimuths from the thrust axis, in [-pi, pi]."""
    turned = phi - axis[:, None]
    return turned - 2 * math.pi * np.round(turned / (2 * math.pi))


def _rounding(pt: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """What bounds in single precision may be wrong by."""
    return 2e-5 * pt.sum(axis=1) * (1 + np.abs(eta).max(axis=1, initial=0.0))


def _jet_costs(a: Event, axis_a: np.ndarray, pz_a: np.ndarray, b: Event, axis_b: np.ndarray, pz_b: np.ndarray, radius: float) -> np.ndarray:
    """What each of the four turns of the aligned distances of pairs costs at least."""
    flip = pz_a * pz_b < 0
    single = lambda event, axis: [np.ascontiguousarray(x.T, np.float32) for x in (event[0], event[1], _turned(event[2], axis))]
    left, right = single(a, axis_a), single(b, axis_b)
    parts = [_nearest_places(*[x[:, s:s + _LOT] for x in left], *[x[:, s:s + _LOT] for x in right], flip[s:s + _LOT], radius) for s in range(0, max(len(flip), 1), _LOT)]
    # single precision is farther off at a smaller radius
    return np.concatenate(parts, axis=1) - (_rounding(*a[:2]) + _rounding(*b[:2])) * max(1.0, BASE_RADIUS / radius)


def best_orientation(
    a: Event, b: Event, radius: float, kind: str,
    axis_a: np.ndarray | None = None, axis_b: np.ndarray | None = None,
    pz_a: np.ndarray | None = None, pz_b: np.ndarray | None = None, steps: int = 15, proof: bool = False,
) -> tuple[np.ndarray, ...]:
    """Smallest distance over orientations of ``a``: (distance, variant number, rotation, flow), and the potentials of all of them."""
    pt, eta, phi = a
    tries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if kind == "thrust":
        eta = np.where((pz_a * pz_b < 0)[:, None], -eta, eta)
        for flipped in (False, True):
            for half_turn in (0.0, math.pi):
                turn = -((-axis_a if flipped else axis_a) - axis_b + half_turn)
                tries.append((eta, (-phi if flipped else phi) + turn[:, None], turn))
    else:
        for flip_eta, flip_phi, turn in variants(kind, steps):
            tries.append((-eta if flip_eta else eta, (-phi if flip_phi else phi) + turn, np.full(len(pt), turn)))
    best = np.full(len(pt), np.inf)
    which, angle, flow = np.zeros(len(pt), int), np.zeros(len(pt)), np.zeros((len(pt), 4, 4))
    prices = []
    if kind == "thrust" and not proof:
        least = _jet_costs(a, axis_a, pz_a, b, axis_b, pz_b, radius)
        solved = _hopeful_costs(pt, [x[:2] for x in tries], b, radius, least)
    else:
        solved = _turned_costs(pt, [x[:2] for x in tries], b, radius, proof, None if kind == "thrust" else _anchors(kind, steps))
    for number, (turn, (value, moved, *price)) in enumerate(zip((t for _, _, t in tries), solved)):
        prices += price
        better = value < best - 1e-9
        best = np.where(better, value, best)
        which[better], angle[better], flow[better] = number, turn[better], moved[better]
    out = best, which, angle % (2 * math.pi), flow
    return (*out, np.stack(prices, axis=1)) if proof else out


_TRIES = 1 << 18  # orientations tried in a batch, of which flow and prices take 208 bytes each

_OUT = [
    T.StructField("distance", T.DoubleType()),
    T.StructField("orientation", T.LongType()),
    T.StructField("rotation", T.DoubleType()),
]
_FLOW = T.StructField("flow", T.ArrayType(T.DoubleType()))
_PRICES = T.StructField("prices", T.ArrayType(T.ArrayType(T.DoubleType())))


def event_distance(
    pairs: DataFrame, kind: str = "thrust", radius: float = BASE_RADIUS, steps: int = 15, with_flow: bool = False, proof: bool = False
) -> DataFrame:
    """Adds ``distance``, ``orientation`` and ``rotation`` (and ``flow``) to a table of event pairs.

    Needs ``src_packed`` and ``tgt_packed``, and for kind "thrust" also ``src_axis``, ``tgt_axis``,
    ``src_pz`` and ``tgt_pz``; these columns are consumed, but with ``proof``, which adds ``flow`` and, for every
    orientation, the ``prices`` that prove its distance. Kinds: nominal, eta_flip, phi_rotation,
    full (flips times rotations) and thrust.
    """
    with_flow = with_flow or proof
    payload = ["src_packed", "tgt_packed"] + (["src_axis", "tgt_axis", "src_pz", "tgt_pz"] if kind == "thrust" else [])
    keep = [c for c in pairs.columns if c not in ("src_packed", "tgt_packed", "src_axis", "tgt_axis", "src_pz", "tgt_pz")]
    if proof:
        keep = [*keep, *payload]
    added = [*_OUT, *[_FLOW] * with_flow, *[_PRICES] * proof]
    schema = T.StructType([pairs.schema[c] for c in keep] + added)

    # flows and prices are held for each orientation, so batches hold a fixed number of orientations, not of pairs
    rows = max(1, _TRIES // (4 if kind == "thrust" else len(variants(kind, steps))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, rows) for whole in batches for start in range(0, whole.num_rows, rows)):
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            events = [unpack(col[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, 12)) for c in payload[:2]]
            extra = [col[c].to_numpy(zero_copy_only=False) for c in payload[2:]]
            value, which, turn, flow, *prices = best_orientation(*events, radius, kind, *extra, steps=steps, proof=proof)
            arrays = [col[c] for c in keep] + [pa.array(value), pa.array(which, pa.int64()), pa.array(turn)]
            names = [*keep, "distance", "orientation", "rotation"]
            if with_flow:
                ends = pa.array(np.arange(0, 16 * batch.num_rows + 1, 16), pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(flow.reshape(-1))))
                names.append("flow")
            for p in prices:
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, 10), pa.int32()), pa.array(p.reshape(-1)))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, p.shape[0] * p.shape[1] + 1, p.shape[1]), pa.int32()), inner))
                names.append("prices")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pairs.select(*dict.fromkeys([*keep, *payload])).mapInArrow(run, schema)


def _parts(pairs: DataFrame) -> int:
    spark = pairs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs read from a written table, dealt as ``attach`` does: few bytes would be read by few tasks."""
    return pairs.repartition(_parts(pairs), "tgt_id")


def attach(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Joins the per-event columns of both sides (from ``with_alignment``) to (src_id, tgt_id) pairs.

    Distances are much work for few bytes, so the shuffle on the target has a fixed number of
    partitions, which adaptive execution does not merge by size: at least two for each core.
    """
    side = lambda df, p: df.select(
        F.col("event_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("packed", "axis", "pz")]
    )
    with_source = pairs.join(side(sources, "src"), "src_id").repartition(_parts(pairs), "tgt_id")
    return with_source.join(side(targets, "tgt"), "tgt_id")


class _Events:
    """Events of an Arrow table as arrays: the packed jets and, for bounds, their marks at ``base`` and jets first, turned to the thrust axis, in single precision."""

    def __init__(self, table: pa.Table, side: str, base: float = BASE_RADIUS):
        column = lambda c: table.column(f"{side}_{c}").combine_chunks()
        lists = lambda c, kind: column(c).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(table.num_rows, -1)
        self.id, self.x = column("id").to_numpy(zero_copy_only=False), column("x").to_numpy(zero_copy_only=False)
        self.packed = lists("packed", float)
        self.axis, self.pz = (column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("axis", "pz"))
        self.blank = ~np.isfinite(np.column_stack([self.packed, self.axis, self.pz])).all(axis=1)
        self.marks = aligned_marks(self.packed, self.axis, self.pz, base).astype(np.float32)
        pt, eta, phi = unpack(self.packed)
        self.pt, self.eta, self.phi = (np.ascontiguousarray(x.T, np.float32) for x in (pt, eta, _turned(phi, self.axis)))
        self.error = _rounding(pt, eta)


def _least_cost(a: _Events, b: _Events, i: np.ndarray, j: np.ndarray, radius: float) -> np.ndarray:
    """What the aligned distances of pairs of events are at least."""
    return _least_costs(a, b, i, j, radius).min(axis=0)


def _least_costs(a: _Events, b: _Events, i: np.ndarray, j: np.ndarray, radius: float) -> np.ndarray:
    """What each of the four turns of the aligned distances costs at least."""
    return _nearest_places(a.pt[:, i], a.eta[:, i], a.phi[:, i], b.pt[:, j], b.eta[:, j], b.phi[:, j], a.pz[i] * b.pz[j] < 0, radius)


def _nearest_places(pa_, ea, fa, pb, eb, fb, flip: np.ndarray, radius: float) -> np.ndarray:
    """What turns cost at least, for jets first and azimuths from the thrust axis: every jet moves to the nearest place of the other event.

    The turned azimuths differ by their difference or their sum, and by half a turn more.
    """
    ea = np.where(flip, -ea, ea)
    half = np.float32(math.pi)
    from_a, from_b = np.full((2, 4, 4, len(flip)), np.inf, np.float32)
    for m in range(4):
        for n in range(4):
            deta = ea[m] - eb[n]
            deta *= deta
            for number, turn in enumerate((fa[m] - fb[n], fa[m] + fb[n])):
                beyond = np.abs(np.abs(turn) - half)
                for half_turn, dphi in enumerate((half - beyond, beyond)):
                    cost, o = deta + dphi * dphi, 2 * number + half_turn
                    np.minimum(from_a[o, m], cost, out=from_a[o, m])
                    np.minimum(from_b[o, n], cost, out=from_b[o, n])
    away = lambda pt, squares: (pt * np.minimum(np.sqrt(squares) / np.float32(radius), 1)).sum(axis=1)
    more = pa_.sum(axis=0) - pb.sum(axis=0)
    return np.maximum(away(pa_, from_a) + np.maximum(-more, 0), away(pb, from_b) + np.maximum(more, 0)).astype(float)


def _within(a: _Events, b: _Events, i: np.ndarray, j: np.ndarray, radius: float, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``best_orientation`` of pairs of events by kind "thrust", infinite above ``most``; turns that cost more at ``least`` are not tried."""
    best = np.full(len(i), np.inf)
    flip = (a.pz[i] * b.pz[j] < 0)[:, None]
    for number in range(4):
        on = np.flatnonzero(least[number] <= np.minimum(most, best))
        if not len(on):
            continue
        # at least two rows, as one alone may be added up in another order
        on_ = np.append(on, on[:1]) if len(on) == 1 else on
        (pt, eta, phi), axis = unpack(a.packed[i[on_]]), a.axis[i[on_]]
        turn = -((-axis if number >= 2 else axis) - b.axis[j[on_]] + (math.pi if number % 2 else 0.0))
        turned = pt, np.where(flip[on_], -eta, eta), (-phi if number >= 2 else phi) + turn[:, None]
        value = transport_cost(turned, unpack(b.packed[j[on_]]), radius, most=np.minimum(most, best)[on_])[0][: len(on)]
        best[on] = np.where(value < best[on] - 1e-9, value, best[on])
    return best


#: targets and sources whose signatures are compared together, pairs bounded or measured together
_ROWS, _COLUMNS, _PAIRS = 256, 1 << 12, 1 << 14
_STEPS = 60  # of a signature's scale within reach


class _Grid:
    """Signatures of sources as whole numbers of one byte, in which those out of reach of a target are found."""

    def __init__(self, marks: np.ndarray, wanted: np.ndarray, room: np.ndarray):
        """``marks`` of sources, ``wanted`` ones of targets; ``room`` is how far these may be apart."""
        self.unit = max(float(room.max()) / _STEPS, 1e-6)
        self.marks, self.known = np.ascontiguousarray(self.steps(marks).T), np.isfinite(marks)
        self.wanted, self.asked = self.steps(wanted), np.isfinite(wanted)
        # places are rounded down, so they may be one step further apart
        self.wide = (np.floor(room / self.unit) + 1).astype(np.uint8)

    def steps(self, marks: np.ndarray) -> np.ndarray:
        # a byte holds the last digit, so what is within reach stays so, and little else has all its numbers there
        return np.floor(np.clip(np.nan_to_num(marks.astype(float)), -1e9, 1e9) / self.unit).astype(np.int64).astype(np.uint8)

    def near(self) -> np.ndarray:
        """Whether no known number of two signatures puts a source out of a target's room."""
        out = np.empty((len(self.wanted), self.marks.shape[1]), bool)
        low = self.wanted - self.wide[:, None]
        unknown = [np.flatnonzero(x) for x in ~self.known.T]
        # few rows at a time, which stay in a core's cache
        for rows in (slice(s, s + 64) for s in range(0, len(out), 64)):
            most = np.zeros(out[rows].shape, np.uint8)
            apart = np.empty_like(most)
            for n, row in enumerate(self.marks):
                # below the room wraps round to a large number
                np.subtract(row, low[rows, n, None], out=apart)
                apart[:, unknown[n]] = 0
                if not self.asked[rows, n].all():
                    apart[~self.asked[rows, n]] = 0
                np.maximum(most, apart, out=most)
            np.less_equal(most, 2 * self.wide[rows, None], out=out[rows])
        return out


def nearest_in_tile(k: int, radius: float, base: float = BASE_RADIUS) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of ``neighbours.knn_in_tiles`` by aligned event distance at ``radius``, derived from that at ``base``.

    Events bring ``packed``, ``axis`` and ``pz``. A pair is measured if neither their marks at ``base``, compared as bytes, nor the cheapest moves of single jets
    put it out of the target's reach, which shrinks as the pairs of least bound are measured first; it is given up as soon as prices put it there. Of pairs just in reach those next in order count.
    Events that are not known in full are infinitely far from all others.
    """
    near, wide = base / radius, (radius - base) / radius

    def as_table(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
        return pa.table({c: np.concatenate(x) for c, x in zip(("tgt_id", "src_id", "src_rank", "centre", "distance"), zip(*parts))})

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [tuple(np.zeros(0, kind) for kind in (int, int, int, int, float))]
        if not left.num_rows or not right.num_rows:
            return as_table(out)
        left, right = left.sort_by("centre"), right.sort_by("src_rank")
        tgt, src = _Events(left, "tgt", base), _Events(right, "src", base)
        lo, hi, centre, reach, edge, seen_lo, seen_hi = (left.column(c).to_numpy() for c in ("lo", "hi", "centre", "reach", "edge", "seen_lo", "seen_hi"))
        rank, reach, edge = right.column("src_rank").to_numpy(), reach.copy(), edge.copy()
        whole = np.flatnonzero(~src.blank)

        def beside(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.abs(rank[j] - centre[i] + 0.5)

        def open_pairs(bound: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (bound < reach[i]) | ((bound <= reach[i]) & (beside(i, j) <= edge[i]))

        def inside(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            r = rank[j]
            return (r >= lo[i]) & (r < hi[i]) & ~((r >= seen_lo[i]) & (r < seen_hi[i]))

        def bounded(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
            """The pairs that may be in reach, with the least costs of their four turns and the bound of their distance."""
            parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros((4, 0)), np.zeros(0))]
            for s in range(0, len(i), _PAIRS):
                i_, j_ = i[s:s + _PAIRS], j[s:s + _PAIRS]
                gap, slack = np.abs(src.x[j_] - tgt.x[i_]) * wide, tgt.error[i_] + src.error[j_]
                least = np.maximum(_least_costs(src, tgt, j_, i_, base) - slack, 0)
                bound = np.maximum(least.min(axis=0) * near + gap - 1e-9 * np.maximum(1.0, np.abs(gap)), 0)
                on = open_pairs(bound, i_, j_)
                parts.append((i_[on], j_[on], least[:, on], bound[on]))
            return tuple(np.concatenate(x, axis=-1) for x in zip(*parts))

        for start in range(0, left.num_rows, _ROWS):
            rows = np.arange(start, min(start + _ROWS, left.num_rows))
            # the k found so far, by place in the tile; -1 for none
            held, place = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1)

            def take(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
                """Adds pairs of targets and sources with their distances."""
                nonlocal held, place
                touched = np.unique(i)
                old = place[touched - start] >= 0
                i = np.concatenate([i, np.broadcast_to(touched[:, None], old.shape)[old]])
                j = np.concatenate([j, place[touched - start][old]])
                value = np.concatenate([value, held[touched - start][old]])
                by = np.lexsort((rank[j], beside(i, j), value, i))
                i, j, value = i[by], j[by], value[by]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, value, nth = (x[nth < k] for x in (i, j, value, nth))
                held[i - start, nth], place[i - start, nth] = value, j
                last = nth == k - 1
                i, j, value = i[last], j[last], value[last]
                further = beside(i, j)
                edge[i] = np.where(value < reach[i], further, np.where(value == reach[i], np.minimum(edge[i], further), edge[i]))
                reach[i] = np.minimum(reach[i], value)

            def measure(i: np.ndarray, j: np.ndarray, least: np.ndarray) -> None:
                for s in range(0, len(i), _PAIRS):
                    i_, j_ = i[s:s + _PAIRS], j[s:s + _PAIRS]
                    gap = np.abs(src.x[j_] - tgt.x[i_]) * wide
                    most = (reach[i_] - gap) / near
                    value = _within(src, tgt, j_, i_, base, least[:, s:s + _PAIRS], most + 1e-9 * np.maximum(1.0, np.abs(most))) * near + gap
                    found = np.isfinite(value)
                    take(i_[found], j_[found], value[found])

            def settle(i: np.ndarray, j: np.ndarray, least: np.ndarray, bound: np.ndarray, waves: int | None = None) -> np.ndarray:
                """Measures pairs, those of least bound first; returns which were measured."""
                by = np.lexsort((beside(i, j), bound, i))
                i, j, least, bound = i[by], j[by], least[:, by], bound[by]
                nth, first, width, done = np.arange(len(i)) - np.searchsorted(i, i), 0, 2 * k, []
                while (nth >= first).any() and waves != len(done):
                    now = np.flatnonzero((nth >= first) & (nth < first + width))
                    now = now[open_pairs(bound[now], i[now], j[now])]
                    measure(i[now], j[now], least[:, now])
                    done.append(i[now] * len(rank) + j[now])
                    first, width = first + width, 2 * width
                return np.concatenate([np.zeros(0, int), *done])

            if src.blank.any() or tgt.blank[rows].any():
                # in parts, as few sources count for a target: those next in order
                far_off = rows[np.isinf(reach[rows])]
                for s in range(0, len(rank), _COLUMNS):
                    i, j = (x.ravel() for x in np.meshgrid(far_off, np.arange(s, min(s + _COLUMNS, len(rank))), indexing="ij"))
                    on = (tgt.blank[i] | src.blank[j]) & inside(i, j) & (beside(i, j) <= edge[i])
                    take(i[on], j[on], np.full(int(on.sum()), np.inf))
            asking = rows[~tgt.blank[rows]]
            # targets without a reach get one from sources of much the same signature next to their place
            new = asking[np.isinf(reach[asking])]
            done = np.zeros(0, int)
            if len(new) and len(whole):
                middle = int(np.searchsorted(rank[whole], np.median(centre[new])))
                begin = max(0, min(middle - _COLUMNS // 2, len(whole) - _COLUMNS))
                some = whole[begin:begin + _COLUMNS]
                marks = np.vstack([tgt.marks[new], src.marks[some]])
                span = np.nan_to_num(np.nanmax(np.where(np.isfinite(marks), marks, -np.inf), axis=0) - np.nanmin(np.where(np.isfinite(marks), marks, np.inf), axis=0))
                step = max(float(np.clip(span, 0, 1e30).max()) / 250, 1e-6)
                low = np.nan_to_num(np.where(np.isfinite(marks), marks, np.inf).min(axis=0), posinf=0.0)
                q = np.clip(np.nan_to_num((marks - low) / step), 0, 250).astype(np.uint8)
                apart = np.zeros((len(new), len(some)), np.uint8)
                for n in range(q.shape[1]):
                    a, b = q[: len(new), n, None], q[len(new):, n]
                    np.maximum(apart, np.maximum(a, b) - np.minimum(a, b), out=apart)
                i, j = np.broadcast_to(new[:, None], apart.shape), np.broadcast_to(some, apart.shape)
                apart[~inside(i, j)] = 255
                few = min(max(64, 8 * k), len(some))
                by = np.argpartition(apart, few - 1, axis=1)[:, :few]
                i, j, on = np.repeat(new, few), some[by].ravel(), np.take_along_axis(apart, by, 1).ravel() < 255
                done = settle(*bounded(i[on], j[on]), waves=1)
            for s in range(0, len(whole), _COLUMNS):
                some = whole[s:s + _COLUMNS]
                first, last = rank[some[0]], rank[some[-1]]
                x_first, x_last = src.x[some].min(), src.x[some].max()
                close = np.maximum(0, np.maximum(x_first - tgt.x[asking], tgt.x[asking] - x_last))
                apart = np.maximum(np.abs(tgt.x[asking] - x_first), np.abs(tgt.x[asking] - x_last))
                room = reach[asking] - np.minimum(close * wide, apart * wide) + (tgt.error[asking] + src.error[some].max()) * near
                room = room / near + 1e-6 * (1 + apart)
                aside = np.maximum(0, np.maximum(first - centre[asking] + 0.5, centre[asking] - 0.5 - last))
                on = (lo[asking] <= last) & (hi[asking] > first) & (room >= 0) & ((reach[asking] > 0) | (aside <= edge[asking]))
                these, room = asking[on], room[on]
                if not len(these):
                    continue
                # single precision of the signatures
                room = room + 1e-5 * np.abs(tgt.marks[these, 0])
                bound_by = np.isfinite(room)
                maybe = np.ones((len(these), len(some)), bool)
                if bound_by.any():
                    maybe[bound_by] = _Grid(src.marks[some], tgt.marks[these[bound_by]], room[bound_by]).near()
                i, j = np.nonzero(maybe)
                i, j = these[i], some[j]
                on = inside(i, j)
                if len(done):
                    on &= ~np.isin(i * len(rank) + j, done)
                settle(*bounded(i[on], j[on]))
            row, nth = np.nonzero(place >= 0)
            t, s = rows[row], place[row, nth]
            out.append((tgt.id[t], src.id[s], rank[s], centre[t], held[row, nth]))
        return as_table(out)

    return search
