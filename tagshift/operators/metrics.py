"""Weighted ROC curves, AUC with negative weights, its intervals, and classifier diagnostics.

Rows are first summed per distinct score, so what has to be ordered is at most one row per score.
Labels are 0 and 1; label 1 is the positive (4b or signal) class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagshift.functions.scores import odds
from tagshift.operators.norms import scalar
from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize


def per_score(df: DataFrame, score: str, label: str, weight: str | None, keys: list[str] | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*(keys or []), F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("w0"),
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("w1"),
    )


def cumulative_scores(df: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    """(score, w0, w1, below0, below1): class weights at a score and in total below it."""
    return ordered_scan(
        per_score(df, score, label, weight), ["score"], running={"below0": "w0", "below1": "w1"}, rank=None
    )


def auc(df: DataFrame, score: str, label: str, weight: str | None = "weight", keys: list[str] | None = None) -> DataFrame:
    """Probability that a positive scores above a negative, ties counting one half.

    Null where a class is missing or its weights cancel.
    """
    keys = keys or []
    grouped = per_score(df, score, label, weight, keys)
    scan = ordered_scan(grouped, ["score"], by=keys, running={"below0": "w0"}, rank=None)
    return scan.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("w1") * (F.col("below0") + 0.5 * F.col("w0"))), F.sum("w0") * F.sum("w1")
        ).alias("auc")
    )


def roc_curve(df: DataFrame, score: str, label: str, weight: str | None = "weight") -> DataFrame:
    """(threshold, fpr, tpr, rank): shares of each class at or above every distinct score."""
    grouped = per_score(df, score, label, weight).withColumn("down", -F.col("score"))
    scan = materialize(ordered_scan(grouped, ["down"], running={"above0": "w0", "above1": "w1"}), "roc")
    totals = scan.agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))
    return scan.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("above0") + F.col("w0"), scalar(totals, "t0")).alias("fpr"),
        F.try_divide(F.col("above1") + F.col("w1"), scalar(totals, "t1")).alias("tpr"),
        "rank",
    )


_PRIME = 2147483647
#: P(count <= k) of a Poisson(1) count
POISSON = [math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def resample_hash(ids: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """ids x replicates: repeatable uniform whole numbers below 2 ** 31 - 1, from plain integer arithmetic."""
    i, k = (ids % _PRIME)[:, None], replicates[None, :]
    a = (i * 48271 + k * 16807 + 12345) % _PRIME
    b = (a * a % _PRIME * 69621 + i + k) % _PRIME
    return (b * b % _PRIME + a * 40692) % _PRIME


def _resampled(replicates: int):
    """Per range of scores and replicate: class sums, the pair sum inside, and the sums at its first and last score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, replicates + 1, dtype=np.int64)
        zero = lambda: np.zeros(replicates)
        n_sum, p_sum, pairs, tie_n, tie_p = zero(), zero(), zero(), zero(), zero()
        first: tuple | None = None
        score = None

        def close():
            nonlocal n_sum, p_sum, pairs, first
            pairs += tie_p * (n_sum + 0.5 * tie_n)
            n_sum, p_sum = n_sum + tie_n, p_sum + tie_p
            first = first or (score, tie_n, tie_p)

        for batch in batches:
            values, labels, weights, ids = (batch.column(i).to_numpy() for i in range(4))
            for lo in range(0, len(values), 512):
                x, y, w, k = (c[lo : lo + 512] for c in (values, labels, weights, ids))
                # Poisson(1) counts of every row in every replicate
                counts = np.searchsorted(POISSON, resample_hash(k, numbers) / _PRIME, "right")
                mass = counts * w[:, None]
                starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                neg = np.add.reduceat(np.where((y == 0)[:, None], mass, 0.0), starts, axis=0)
                pos = np.add.reduceat(np.where((y == 1)[:, None], mass, 0.0), starts, axis=0)
                for j, at in enumerate(starts):
                    if score is None or x[at] != score:
                        if score is not None:
                            close()
                        score, tie_n, tie_p = x[at], zero(), zero()
                    tie_n, tie_p = tie_n + neg[j], tie_p + pos[j]
        if score is None:
            return
        close()
        part = TaskContext.get().partitionId()
        ends = [first] if first[0] == score else [first, (score, tie_n, tie_p)]
        for at, n, p in ends:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(replicates, part)), pa.array(numbers), pa.array(np.full(replicates, float(at))), pa.array(n), pa.array(p), pa.nulls(replicates, pa.float64())],
                ["part", "replicate", "at", "n", "p", "pairs"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(replicates, part)), pa.array(numbers), pa.nulls(replicates, pa.float64()), pa.array(n_sum), pa.array(p_sum), pa.array(pairs)],
            ["part", "replicate", "at", "n", "p", "pairs"])

    return run


def bootstrap_auc(
    df: DataFrame, score: str, label: str, weight: str, replicates: int = 1000, alpha: float = 0.05, id_col: str = "event_id",
) -> DataFrame:
    """Percentile interval of the AUC over resampled tables: (lower, upper, replicates).

    Resampling n of n rows is done by independent Poisson(1) counts per row and replicate, which
    needs no row to know about another; counts come from a hash of the row id, so a lost task
    redraws the same sample. Rows are ordered once, by score and id, so a score that many rows share
    spreads over ranges; each range adds up all replicates and returns three rows for each at most.
    Pairs of equal score in different ranges are set to one half when the ranges are combined.
    """
    rows = df.select(F.col(score).cast("double").alias("x"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), F.col(id_col).cast("long").alias("i"))
    rows = rows.repartitionByRange("x", "i").sortWithinPartitions("x", "i")
    sums = materialize(rows.mapInArrow(_resampled(replicates), "part long, replicate long, at double, n double, p double, pairs double"), "replicates")
    # a row for each range and replicate: windows hold no more rows than there are ranges
    earlier = W.partitionBy("replicate").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tied = W.partitionBy("replicate", "at").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = sums.where("at IS NULL").select(
        "replicate", "n", "p", (F.col("pairs") + F.col("p") * F.coalesce(F.sum("n").over(earlier), F.lit(0.0))).alias("pairs"))
    ties = sums.where("at IS NOT NULL").select("replicate", F.lit(0.0).alias("n"), F.lit(0.0).alias("p"), (
        0.5 * F.col("n") * F.coalesce(F.sum("p").over(tied), F.lit(0.0)) - 0.5 * F.col("p") * F.coalesce(F.sum("n").over(tied), F.lit(0.0))).alias("pairs"))
    each = whole.unionByName(ties).groupBy("replicate").agg(F.try_divide(F.sum("pairs"), F.sum("n") * F.sum("p")).alias("auc"))
    return each.agg(
        F.percentile("auc", F.lit(alpha / 2)).alias("lower"),
        F.percentile("auc", F.lit(1 - alpha / 2)).alias("upper"),
        F.count("auc").alias("replicates"),
    )


def _placements(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row of sums over placements; ``v`` counts opposite-class rows on the right side of a row."""
    scan = materialize(cumulative_scores(df, score, label, None), "placements")
    totals = scan.agg(F.sum("w0").alias("nx"), F.sum("w1").alias("ny"))
    t = scan.withColumn("nx", scalar(totals, "nx")).withColumn("ny", scalar(totals, "ny"))
    # v_x: positives above a negative row; v_y: negatives below a positive row
    t = t.withColumn("v_x", F.col("ny") - F.col("below1") - 0.5 * F.col("w1")).withColumn(
        "v_y", F.col("below0") + 0.5 * F.col("w0")
    )
    t = t.withColumn("u_x", F.col("ny") - F.col("v_x")).withColumn("u_y", F.col("nx") - F.col("v_y"))

    def spread(u: Column, v: Column) -> Column:
        return u * (u - 1) + v * (v - 1) - 2 * u * v

    return t.agg(
        F.max("nx").alias("nx"), F.max("ny").alias("ny"),
        F.sum(F.col("w1") * spread(F.col("u_y"), F.col("v_y"))).alias("s_xxy"),
        F.sum(F.col("w0") * spread(F.col("u_x"), F.col("v_x"))).alias("s_yyx"),
        F.sum(F.col("w1") * F.col("v_y")).alias("s_v"),
        F.sum(F.col("w0") * F.col("v_x") * F.col("v_x")).alias("s_vx2"),
        F.sum(F.col("w1") * F.col("v_y") * F.col("v_y")).alias("s_vy2"),
        F.sum(F.col("w0") * F.col("w1")).alias("ties"),
    ).withColumn("auc", F.try_divide("s_v", F.col("nx") * F.col("ny")))


def _wald(df: DataFrame, alpha: float) -> DataFrame:
    half = F.lit(NormalDist().inv_cdf(1 - alpha / 2)) * F.sqrt("variance")
    return df.select("auc", "variance", (F.col("auc") - half).alias("lower"), (F.col("auc") + half).alias("upper"))


def bamber_interval(df: DataFrame, score: str, label: str, alpha: float = 0.05) -> DataFrame:
    """Bamber (1975) interval of the unweighted AUC, with P(x != y) taken as 1."""
    p = _placements(df, score, label)
    nx, ny = F.col("nx"), F.col("ny")
    b_xxy = F.try_divide("s_xxy", nx * (nx - 1) * ny)
    b_yyx = F.try_divide("s_yyx", ny * (ny - 1) * nx)
    centred = F.col("auc") - 0.5
    spread = 1 + (nx - 1) * b_xxy + (ny - 1) * b_yyx - 4 * (nx + ny - 1) * centred * centred
    v = F.try_divide(spread, 4 * (nx - 1) * (ny - 1))
    return _wald(p.withColumn("variance", v), alpha)


def hanley_mcneil_interval(df: DataFrame, score: str, label: str, alpha: float = 0.05) -> DataFrame:
    """Hanley and McNeil interval of the unweighted AUC with squared placements."""
    p = _placements(df, score, label)
    nx, ny, a = F.col("nx"), F.col("ny"), F.col("auc")
    q1 = F.try_divide("s_vx2", nx * ny * ny)
    q2 = F.try_divide("s_vy2", ny * nx * nx)
    tied = F.try_divide("ties", nx * ny)
    spread = a * (1 - a) - 0.25 * tied + (ny - 1) * (q1 - a * a) + (nx - 1) * (q2 - a * a)
    v = F.try_divide(spread, (nx - 1) * (ny - 1))
    return _wald(p.withColumn("variance", v), alpha)


def best_threshold(
    roc: DataFrame, signal_sum: Column, background_sum: Column, luminosity_ratio: float = 1.0,
    min_tpr: float = 0.10, min_fpr: float = 0.001, floor: float = 2.5,
) -> DataFrame:
    """Threshold of the largest S / sqrt(S + B + floor); ties go to the larger threshold.

    S counts as 0 below ``min_tpr`` and B as 1e9 below ``min_fpr``.
    """
    ratio = F.lit(luminosity_ratio)
    t = roc.withColumn("S", F.when(F.col("tpr") < min_tpr, 0.0).otherwise(F.col("tpr") * signal_sum * ratio))
    t = t.withColumn("B", F.when(F.col("fpr") < min_fpr, 1.0e9).otherwise(F.col("fpr") * background_sum * ratio))
    t = t.withColumn("sigma", F.col("S") / F.sqrt(F.col("S") + F.col("B") + floor))
    top = t.agg(F.max_by(F.struct("threshold", "sigma", "S", "B", "tpr", "fpr"), F.struct("sigma", "threshold")).alias("m"))
    return top.select("m.*")


def interpolated(points: DataFrame, curve: DataFrame) -> DataFrame:
    """Adds ``y_at`` to ``points`` (id, x): the curve (x, y, x unique) read linearly at each x.

    Outside the curve its first or last segment is extended. Each point finds its segment by the
    number of curve points not above it, so the lookup is an equi join.
    """
    both = curve.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "x", "y").unionByName(
        points.select(F.lit(1).alias("kind"), "id", "x", F.lit(None).cast("double").alias("y"))
    ).withColumn("on_curve", (1 - F.col("kind")).cast("long"))
    scan = materialize(ordered_scan(both, ["x", "kind", "id"], running={"n_before": "on_curve"}, rank=None), "curve")
    knots = scan.where(F.col("kind") == 0).select(F.col("n_before").alias("k"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    n = scalar(knots.agg(F.count(F.lit(1)).alias("n")), "n")
    segments = knots.join(
        knots.select((F.col("k") - 1).alias("k"), F.col("x0").alias("x1"), F.col("y0").alias("y1")), "k"
    )
    asked = scan.where(F.col("kind") == 1).select("id", "x", "n_before").withColumn("_n", n)
    asked = asked.select("id", "x", F.greatest(F.lit(0), F.least(F.col("n_before") - 1, F.col("_n") - 2)).alias("k"))
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return asked.join(segments, "k").select("id", "x", line.alias("y_at"))


def step_tops(roc: DataFrame) -> DataFrame:
    """One point per fpr, the top of its vertical step: (x, y)."""
    return roc.groupBy(F.col("fpr").alias("x")).agg(F.max("tpr").alias("y"))


def overtraining(train_roc: DataFrame, valid_roc: DataFrame, train_auc: DataFrame) -> DataFrame:
    """Area between the training and validation curves and its percentage of the area gained."""
    train = materialize(ordered_scan(step_tops(train_roc), ["x"]), "train_roc")
    at = interpolated(train.select(F.col("rank").alias("id"), "x"), step_tops(valid_roc))
    gaps = materialize(
        train.join(at.select(F.col("id").alias("rank"), "y_at"), "rank").select(
            "rank", "x", F.abs(F.col("y") - F.col("y_at")).alias("gap")
        ), "gaps"
    )
    following = gaps.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("x1"), F.col("gap").alias("gap1"))
    area = gaps.join(following, "rank").agg(
        F.sum((F.col("x1") - F.col("x")) * (F.col("gap") + F.col("gap1")) / 2).alias("area")
    )
    gain = F.greatest(scalar(train_auc, "auc") - 0.5, F.lit(0.0))
    return area.withColumn("gain", gain).select("area", F.try_divide(100 * F.col("area"), F.col("area") + F.col("gain")).alias("percent"))


def calibration(df: DataFrame, label: str, p1: str, weight: str) -> DataFrame:
    """Per class: weighted mean probability, expected fraction and their ratio."""
    y, p, w = F.col(label), F.col(p1), F.col(weight)
    s = df.agg(
        F.sum(w).alias("w"), F.sum(w * p).alias("wp"), F.sum(F.when(y == 1, w).otherwise(0.0)).alias("w1")
    )
    rows = F.array(
        F.struct(F.lit("4b").alias("class"), F.try_divide("wp", "w").alias("mean_p"), F.try_divide("w1", "w").alias("expected")),
        F.struct(F.lit("3b").alias("class"), (1 - F.try_divide("wp", "w")).alias("mean_p"), (1 - F.try_divide("w1", "w")).alias("expected")),
    )
    return s.select(F.explode(rows).alias("r")).select("r.*").withColumn("scale", F.try_divide("expected", "mean_p"))


def closure(df: DataFrame, label: str, p1: str, weight: str) -> DataFrame:
    """Reweighted 3b sum and the 4b sum over it."""
    y, p, w = F.col(label), F.col(p1), F.col(weight)
    s = df.agg(
        F.sum(F.when(y == 0, w * odds(p)).otherwise(0.0)).alias("norm_b"),
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("w4"),
    )
    return s.select("norm_b", F.try_divide("w4", "norm_b").alias("d4_over_b"))
