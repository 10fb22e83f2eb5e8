"""Nearest neighbours of targets among sources, inside the sT band of shared half-step blocks.

Two events share a half-step block when their half-steps differ by at most one, which makes the
allowed sources of a target one interval of source ranks. Candidates are read outwards from the
target's own place in that interval, so only pairs that can still matter are ever formed: for
|delta sT| the first K on either side are enough, and for the event distance, which is never below
|delta sT|, the search widens only for targets whose K-th distance does not yet exclude the rest.
Where most of a band has to be looked at, targets and sources meet in tiles, and only what was found leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagshift.constants import HALF_STEPS
from tagshift.operators.blocks import half_step, step_size
from tagshift.operators.norms import scalar
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize


def merge_positions(targets: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places two tables (id, x) on one axis.

    Returns targets with ``tgt_rank`` and ``place`` = number of sources with x not above the
    target's, and sources with ``src_rank``.
    """
    both = sources.select("id", "x", F.lit(0).alias("kind")).unionByName(
        targets.select("id", "x", F.lit(1).alias("kind"))
    ).withColumn("is_source", (1 - F.col("kind")).cast("long"))
    placed = materialize(ordered_scan(both, ["x", "kind", "id"], running={"n_src": "is_source"}), "placed")
    tgt = placed.where(F.col("kind") == 1).select(
        F.col("id").alias("tgt_id"), F.col("x").alias("tgt_x"),
        (F.col("rank") - F.col("n_src")).alias("tgt_rank"), F.col("n_src").alias("place"),
    )
    src = placed.where(F.col("kind") == 0).select(
        F.col("id").alias("src_id"), F.col("x").alias("src_x"), F.col("n_src").alias("src_rank")
    )
    return tgt, src


def banded(targets: DataFrame, sources: DataFrame, steps: int = HALF_STEPS) -> tuple[DataFrame, DataFrame]:
    """Targets with the rank interval [lo, hi) of their allowed sources and the ``centre`` in it."""
    tgt, src = merge_positions(targets, sources)
    n_tgt = scalar(tgt.agg(F.count(F.lit(1)).alias("n")), "n")
    n_src = scalar(src.agg(F.count(F.lit(1)).alias("n")), "n")
    tgt = tgt.withColumn("_n", n_src).withColumn("_size", step_size(F.col("_n"), steps)).withColumn(
        "_step", half_step(F.col("tgt_rank"), n_tgt, steps)
    )
    # the last step ends with the last source; with fewer sources than steps the band stays on them
    hi = F.when(F.col("_step") + 2 >= steps, F.col("_n")).otherwise(F.least("_n", (F.col("_step") + 2) * F.col("_size")))
    lo = F.greatest(F.lit(0), F.least(F.col("_step") - 1, F.expr("(_n - 1) div _size")) * F.col("_size"))
    tgt = tgt.withColumn("lo", lo).withColumn("hi", hi)
    return tgt.withColumn("centre", F.greatest("lo", F.least("hi", "place"))).drop("_n", "_step", "_size"), src


def ring(targets: DataFrame, sources: DataFrame, inner: int, outer: int) -> DataFrame:
    """Pairs whose source lies between ``inner`` and ``outer`` ranks from the centre, on either side."""
    keep = ["tgt_id", "tgt_x", "lo", "hi", "centre"]
    left = F.when(
        F.greatest(F.col("centre") - outer, F.col("lo")) < F.col("centre") - inner,
        F.sequence(F.greatest(F.col("centre") - outer, F.col("lo")), F.col("centre") - inner - 1),
    )
    right = F.when(
        F.least(F.col("centre") + outer, F.col("hi")) > F.col("centre") + inner,
        F.sequence(F.col("centre") + inner, F.least(F.col("centre") + outer, F.col("hi")) - 1),
    )
    none = F.array().cast("array<bigint>")
    ranks = F.concat(F.coalesce(left, none), F.coalesce(right, none))
    extra = [c for c in targets.columns if c not in keep]
    exploded = targets.select(*keep, *extra, F.explode(ranks).alias("src_rank"))
    return exploded.join(sources, "src_rank").withColumn(
        "gap", F.abs(F.col("src_x") - F.col("tgt_x"))
    )


def nearest(pairs: DataFrame, k: int, distance: str = "distance") -> DataFrame:
    """The k nearest sources of each target; ties go to the source next in rank to the centre."""
    w = W.partitionBy("tgt_id").orderBy(
        distance, F.abs(F.col("src_rank") - F.col("centre") + F.lit(0.5)), "src_rank"
    )
    return pairs.withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= k)


def knn_by_gap(targets: DataFrame, sources: DataFrame, k: int, steps: int = HALF_STEPS) -> DataFrame:
    """Exact k nearest by |delta sT|: (tgt_id, src_id, distance, nn)."""
    tgt, src = banded(targets, sources, steps)
    pairs = ring(tgt, src, 0, k).withColumn("distance", F.col("gap"))
    return nearest(pairs, k).select("tgt_id", "src_id", "distance", "nn")


def knn_by_distance(
    targets: DataFrame,
    sources: DataFrame,
    k: int,
    measure: Callable[[DataFrame], DataFrame],
    steps: int = HALF_STEPS,
    first_width: int | None = None,
) -> DataFrame:
    """Exact k nearest under ``measure``, a distance that is never below |delta sT|.

    ``measure`` adds ``distance`` to a table of (tgt_id, src_id, gap, ...). Each round doubles the
    reach for the targets that are not settled; a target is settled once its k-th distance is no
    larger than the gap to the nearest source not looked at, or its band is used up.
    """
    tgt, src = banded(targets, sources, steps)
    tgt, src = materialize(tgt, "targets"), materialize(src, "sources")
    open_targets = tgt.withColumn("bound", F.lit(None).cast("double"))
    found: DataFrame | None = None
    settled: list[DataFrame] = []
    inner, outer = 0, first_width or 2 * k
    cols = ["tgt_id", "src_id", "src_rank", "centre", "distance"]
    while True:
        pairs = ring(open_targets, src, inner, outer)
        # a pair further apart in sT than the k-th distance so far cannot be among the k nearest
        pairs = pairs.where(F.col("bound").isNull() | (F.col("gap") <= F.col("bound")))
        fresh = measure(pairs).select(*cols)
        pool = fresh if found is None else fresh.unionByName(found)
        best = materialize(nearest(pool, k).drop("nn"), "nearest")
        kth = best.groupBy("tgt_id").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n_found"))
        reach = open_targets.drop("bound").join(kth, "tgt_id", "left")
        # sT of the outermost sources looked at bounds the gap to everything further out
        edge_l = src.select((F.col("src_rank") + outer).alias("centre"), F.col("src_x").alias("x_l"))
        edge_r = src.select((F.col("src_rank") - outer + 1).alias("centre"), F.col("src_x").alias("x_r"))
        reach = reach.join(edge_l, "centre", "left").join(edge_r, "centre", "left")
        open_l = F.col("centre") - outer > F.col("lo")
        open_r = F.col("centre") + outer < F.col("hi")
        full = F.coalesce(F.col("n_found") >= k, F.lit(False))
        done_l = ~open_l | (full & (F.col("kth") < F.abs(F.col("tgt_x") - F.col("x_l"))))
        done_r = ~open_r | (full & (F.col("kth") < F.abs(F.col("tgt_x") - F.col("x_r"))))
        state = materialize(
            reach.withColumn("done", done_l & done_r).withColumn("bound", F.when(full, F.col("kth"))), "reach"
        )
        done_ids = state.where("done").select("tgt_id")
        settled.append(best.join(done_ids, "tgt_id", "left_semi"))
        open_targets = state.where(~F.col("done")).select(*tgt.columns, "bound")
        if open_targets.isEmpty():
            break
        found = best.join(open_targets.select("tgt_id"), "tgt_id", "left_semi")
        inner, outer = outer, 2 * outer
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return nearest(result, k).select("tgt_id", "src_id", "distance", "nn")


def _bound(widen: Callable[[Column, Column], Column] | None) -> Column:
    """What the distance of a pair is at least, from the signatures of both."""
    apart = F.array_max(F.zip_with("src_sig", "tgt_sig", lambda a, b: F.abs(a - b)))
    return apart if widen is None else widen(apart, F.col("gap"))


def within_bounds(targets: DataFrame, sources: DataFrame, widen: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs whose source lies in the target's band and whose distance may be no larger than the target's ``reach``.

    Targets are (tgt_id, tgt_x, lo, hi, centre, tgt_sig, reach), sources (src_id, src_x, src_rank, src_sig). A target looks into squares of
    the second and third number of the signature that are at least as wide as its reach, so into nine at most;
    a source stands in one square of each width in use. Widths are powers of two.
    """
    level = F.greatest(F.lit(-40), F.least(F.lit(40), F.ceil(F.log2("reach")))).cast("int")
    wide = F.pow(F.lit(2.0), F.col("level"))
    looking = targets.withColumn("level", F.when(F.col("reach") > 0, level).otherwise(-40))
    # of at most 81 widths
    levels = [r[0] for r in looking.select("level").distinct().collect()]
    if not levels:
        levels = [0]
    square = lambda v: F.floor(v / wide)
    for i in (1, 2):
        v, reach = F.col("tgt_sig")[i], F.col("reach") * (1 + 1e-9)
        looking = looking.withColumn(f"c{i}", F.explode(F.sequence(square(v - reach), square(v + reach))))
    standing = sources.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    standing = standing.select("*", *[square(F.col("src_sig")[i]).alias(f"c{i}") for i in (1, 2)])
    pairs = looking.join(standing, ["level", "c1", "c2"]).where("src_rank >= lo AND src_rank < hi").drop("level", "c1", "c2")
    pairs = pairs.withColumn("gap", F.abs(F.col("src_x") - F.col("tgt_x")))
    return pairs.where(_bound(widen) <= F.col("reach") * (1 + 1e-9) + 1e-9)


def knn_by_bounds(
    targets: DataFrame, sources: DataFrame, k: int, measure: Callable[[DataFrame], DataFrame], steps: int = HALF_STEPS,
    widen: Callable[[Column, Column], Column] | None = None, first_width: int | None = None,
) -> DataFrame:
    """Exact k nearest under ``measure``; inputs are (id, x, signature), x giving the band.

    No number of two signatures may differ by more than the distance (a null tells nothing); ``widen`` turns the largest difference and the gap in x into
    a bound of a distance derived from it, which is then the one that ``measure`` gives. Two rounds: the 4 k sources with the least bounds
    among those next in order give each target a reach, within which its k nearest lie; then
    the other sources whose bound is within reach are measured. Every pair measured is a row, with both signatures on its way there;
    ``knn_in_tiles`` needs none.
    """
    tgt, src = banded(targets, sources, steps)
    with_sig = lambda df, side, p: df.join(side.select(F.col("id").alias(f"{p}_id"), F.col("signature").alias(f"{p}_sig")), f"{p}_id")
    tgt, src = materialize(with_sig(tgt, targets, "tgt"), "targets"), materialize(with_sig(src, sources, "src"), "sources")
    cols = ["tgt_id", "src_id", "src_rank", "centre", "distance"]
    plain = lambda pairs: pairs.drop("src_sig", "tgt_sig", "reach")
    beside = ring(tgt, src, 0, first_width or max(8 * k, 32)).withColumn("bound", _bound(widen))
    least = W.partitionBy("tgt_id").orderBy("bound", "src_rank")
    chosen = beside.withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= 4 * k).drop("_nth", "bound")
    first = materialize(measure(plain(chosen)).select(*cols), "first")
    kth = nearest(first, k).groupBy("tgt_id").agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("_n"))
    # a target that found fewer has no other source in its band
    open_targets = tgt.join(kth.where(F.col("_n") == k).drop("_n"), "tgt_id")
    more = within_bounds(open_targets, src, widen).join(first.select("tgt_id", "src_id"), ["tgt_id", "src_id"], "left_anti")
    return nearest(first.unionByName(measure(plain(more)).select(*cols)), k).select("tgt_id", "src_id", "distance", "nn")


#: targets and sources of a tile
TILE = (1024, 4096)
#: how many times as many either may be where there are many of them
WIDER = (4, 8)


def knn_in_tiles(
    targets: DataFrame, sources: DataFrame, k: int, search: Callable[[pa.Table, pa.Table], pa.Table], steps: int = HALF_STEPS, tile: tuple[int, int] = TILE,
    wider: tuple[int, int] | None = None, by_gap: bool = False,
) -> DataFrame:
    """Exact k nearest where a target's band holds too many sources for a row each; inputs are (id, x, ...), x giving the band.

    Pairs are never rows of a table: targets and sources next in rank meet in tiles of fixed size. ``search`` is given a tile, as targets
    (tgt_id, tgt_x, lo, hi, centre, reach, edge, seen_lo, seen_hi, ...) and sources (src_id, src_x, src_rank, ...) with the inputs' further columns, and returns
    (tgt_id, src_id, src_rank, centre, distance) of the k nearest sources that a target has there, or of those within its reach, in the order of
    ``nearest``; sources that are just in reach count if they are no further from the centre than ``edge``, those of ranks [seen_lo, seen_hi) do not count.
    Two rounds: the tile of a target's own place gives it a reach, then those of its other tiles are searched that may hold something within it: ``by_gap`` says
    that no distance is below the gap in x.
    """
    tgt, src = banded(targets, sources, steps)
    extra = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), *[c for c in df.columns if c not in ("id", "x")])
    cores = tgt.sparkSession.sparkContext.defaultParallelism
    if wider is None:
        # as long as there are tiles for all cores, the wider a tile, the sooner a target's reach shrinks
        n_tgt, n_src = targets.count(), sources.count()
        wider = max(1, min(WIDER[0], n_tgt // (4 * cores * tile[0]))), max(1, min(WIDER[1], 3 * n_src // (4 * steps * tile[1])))
    size = tile[1] * wider[1]
    at = lambda rank, size: F.expr(f"({rank}) div {size}")
    tgt = tgt.where("lo < hi").withColumn("rows", F.expr(f"tgt_rank div {tile[0] * wider[0]}")).withColumn("own", at("greatest(lo, least(hi - 1, centre))", tile[1]))
    tgt = materialize(tgt.join(extra(targets, "tgt"), "tgt_id"), "targets")
    src = materialize(src.join(extra(sources, "src"), "src_id"), "sources")
    schema = "tgt_id bigint, src_id bigint, src_rank bigint, centre bigint, distance double"

    def searched(asking: DataFrame, size: int) -> DataFrame:
        # one row for each tile, dealt to about as many tasks, which adaptive execution does not merge by size
        tiles = materialize(asking.select("rows", "columns").distinct(), "tiles")
        parts = max(2 * cores, min(50 * cores, tiles.count()))
        deal = lambda df: df.repartition(parts, "rows", "columns").groupBy("rows", "columns")
        found = deal(asking.drop("own", "tgt_rank")).cogroup(deal(src.withColumn("columns", at("src_rank", size)).join(F.broadcast(tiles), "columns"))).applyInArrow(search, schema)
        return materialize(found, "found")

    far = F.lit(float("inf"))
    none = F.lit(0).cast("long")
    first = searched(tgt.select("*", F.col("own").alias("columns"), far.alias("reach"), far.alias("edge"), none.alias("seen_lo"), none.alias("seen_hi")), tile[1])
    beside = lambda rank: F.abs(rank - F.col("centre") + F.lit(0.5))
    last = F.max(F.struct("distance", beside(F.col("src_rank")).alias("edge")))
    kth = first.groupBy("tgt_id").agg(last.alias("_last"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    known = tgt.join(kth, "tgt_id", "left").select(
        *tgt.columns, F.coalesce("_last.distance", far).alias("reach"), F.coalesce("_last.edge", far).alias("edge"),
        (F.col("own") * tile[1]).alias("seen_lo"), ((F.col("own") + 1) * tile[1]).alias("seen_hi"))
    # one row for each tile
    ranges = src.groupBy(at("src_rank", size).alias("columns")).agg(
        F.min("src_x").alias("_x_lo"), F.max("src_x").alias("_x_hi"), F.min("src_rank").alias("_lo"), F.max("src_rank").alias("_hi"))
    others = known.withColumn("columns", F.explode(F.sequence(at("lo", size), at("hi - 1", size)))).join(F.broadcast(ranges), "columns")
    unseen = (F.greatest("_lo", "lo") < F.col("seen_lo")) | (F.least(F.col("_hi") + 1, "hi") > F.col("seen_hi"))
    # of a distance of 0 no more is known than that it is the least
    away = F.greatest(F.lit(0.0), F.col("_x_lo") - F.col("tgt_x"), F.col("tgt_x") - F.col("_x_hi")) * (1 - 1e-9) - 1e-4 if by_gap else F.lit(0.0)
    next_to = F.greatest(F.lit(0.0), F.col("_lo") - F.col("centre") + 0.5, F.col("centre") - 0.5 - F.col("_hi"))
    hopeful = (F.greatest(F.lit(0.0), away) < F.col("reach")) | ((away <= F.col("reach")) & (next_to <= F.col("edge")))
    others = others.where(unseen & F.coalesce(hopeful, F.lit(True))).drop("_x_lo", "_x_hi", "_lo", "_hi")
    return nearest(first.unionByName(searched(others, size)), k).select("tgt_id", "src_id", "distance", "nn")


def inverse_distance_shares(knn: DataFrame) -> DataFrame:
    """Adds ``share``: 1/distance over its sum per target; zero distances take the whole share."""
    w = W.partitionBy("tgt_id")
    zeros = F.sum((F.col("distance") == 0).cast("int")).over(w)
    inverse = F.when(F.col("distance") != 0, 1.0 / F.col("distance"))
    share = F.when(zeros > 0, F.when(F.col("distance") == 0, 1.0 / zeros).otherwise(0.0)).otherwise(
        inverse / F.sum(inverse).over(w)
    )
    return knn.withColumn("share", share)


def neighbour_weights(knn: DataFrame) -> DataFrame:
    """Summed shares of each source that is a neighbour of some target: (src_id, nn_weight)."""
    return inverse_distance_shares(knn).groupBy("src_id").agg(F.sum("share").alias("nn_weight"))
