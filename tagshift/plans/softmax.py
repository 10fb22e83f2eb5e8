"""Softmax classifiers of any number of classes on signed weights, trained by summed gradients.

Every step is one scan of the training table for all settings of a sweep together: a task adds up loss and gradient of each
setting's trial point over its Arrow batches, Spark adds up the tasks, and the driver, which holds one small vector
per setting, takes the next step of limited-memory BFGS. Its first curvature is that of the loss where all classes are equally likely,
which only needs the covariance of the features, so correlated features do not cost many steps. Weights may be negative, as generators give them; the loss is the weighted
cross-entropy over the sum of weights, plus half of ``l2`` times the squared coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY, ROUNDS, TOLERANCE = 10, 60, 1e-7
LEAST_CURVATURE = 1e-3  # of the largest, in directions without any
Point = np.ndarray
Value = tuple[float, np.ndarray]


@dataclass
class Softmax:
    """Coefficients by class and feature, the last column being the constant, for features of the given centre and width."""

    weights: np.ndarray
    centre: np.ndarray
    width: np.ndarray
    loss: float
    evaluations: int


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spread(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Mean and width of each feature (1 where it does not vary), the sum of weights and the features' correlations, from one scan."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                sums = sums + np.concatenate([[len(x), batch.column(1).to_numpy().sum()], x.sum(axis=0), (x * x).sum(axis=0), (x.T @ x).ravel()])
        if np.size(sums) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["slot", "value"])

    rows = df.select("x", "w").mapInArrow(add, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    sums = np.array([r.value for r in sorted(rows, key=lambda r: r.slot)])
    if not len(sums) or not sums[1] > 0:
        raise ValueError("training needs rows whose weights add up to more than 0")
    size = round(np.sqrt(len(sums) - 1)) - 1  # 2 + 2 k + k k numbers for k features
    x, xx, products = np.split(sums[2:] / sums[0], [size, 2 * size])
    width = np.sqrt(np.maximum(xx - x * x, 0.0))
    width = np.where(width > 1e-9 * np.maximum(np.abs(x), 1.0), width, 1.0)
    return x, width, float(sums[1]), (products.reshape(size, size) - np.outer(x, x)) / np.outer(width, width)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> Value:
    """Weighted cross-entropy of rows, not divided by anything, and its gradient by class and feature."""
    logits = x @ weights[:, :-1].T + weights[:, -1]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=1)
    at = np.arange(len(y))
    loss = float((w * (np.log(total) - logits[at, y])).sum())
    p /= total[:, None]
    p[at, y] -= 1
    p *= w[:, None]
    return loss, np.hstack([p.T @ x, p.sum(axis=0)[:, None]])


def _evaluate(df: DataFrame, points: dict[int, np.ndarray], centre: np.ndarray, width: np.ndarray) -> dict[int, Value]:
    """Loss and gradient of every point, from one scan."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(v.size + 1) for k, v in points.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch.column(0)) - centre) / width
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k, v in points.items():
                loss, gradient = loss_and_gradient(x, y, w, v)
                sums[k][0] += loss
                sums[k][1:] += gradient.ravel()
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), pa.array(s)], ["setting", "slot", "value"])

    out = {k: np.zeros(v.size + 1) for k, v in points.items()}
    for r in df.mapInArrow(add, "setting int, slot int, value double").groupBy("setting", "slot").agg(F.sum("value").alias("value")).collect():
        out[r.setting][r.slot] = r.value
    return {k: (s[0], s[1:].reshape(points[k].shape)) for k, s in out.items()}


def _curvature(correlations: np.ndarray, classes: int, l2: float) -> Callable[[np.ndarray], np.ndarray]:
    """Divides a gradient by the curvature where all classes are equally likely; constants have that of a feature of width 1."""
    if not np.isfinite(correlations).all():
        return lambda g: g
    size, vectors = np.linalg.eigh(correlations)
    size = np.maximum(size, 0.0) / classes + l2
    inverse = (vectors / np.maximum(size, LEAST_CURVATURE * max(size.max(initial=0.0), 1.0 / classes))) @ vectors.T

    def divide(gradient: np.ndarray) -> np.ndarray:
        g = gradient.reshape(classes, -1)
        return np.hstack([g[:, :-1] @ inverse, classes * g[:, -1:]]).ravel()

    return divide


def _minimise(start: Point, rounds: int, tolerance: float, divide: Callable[[np.ndarray], np.ndarray] = lambda g: g) -> Generator[Point, Value, tuple[Point, float, int]]:
    """Limited-memory BFGS that asks for values by yielding points; returns the best point, its value and the number of questions.

    ``divide`` applies the inverse of a first, positive curvature.
    """
    x = start.ravel()
    value, gradient = yield x.reshape(start.shape)
    gradient, asked = gradient.ravel(), 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= tolerance:
            break
        q, alphas = gradient.copy(), []
        for s, g in reversed(steps):
            alphas.append(s @ q / (s @ g))
            q -= alphas[-1] * g
        q = divide(q)
        if steps:
            s, g = steps[-1]
            q *= s @ g / (g @ divide(g))
        for (s, g), a in zip(steps, reversed(alphas)):
            q += (a - g @ q / (s @ g)) * s
        slope = gradient @ q
        if not slope > 0:
            q, slope, steps = gradient, gradient @ gradient, []
        step = 1.0 if steps else min(1.0, 1.0 / np.sqrt(slope))
        while step > 1e-10:
            new = x - step * q
            new_value, new_gradient = yield new.reshape(start.shape)
            asked += 1
            if np.isfinite(new_value) and new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        new_gradient = new_gradient.ravel()
        s, g = new - x, new_gradient - gradient
        if s @ g > 1e-12 * (g @ g):
            steps = [*steps, (s, g)][-MEMORY:]
        done = value - new_value <= 1e-12 * max(abs(value), 1.0)
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x.reshape(start.shape), value, asked


def train(
    df: DataFrame, classes: int, l2: list[float], features: str = "features", label: str = "label", weight: str = "train_weight",
    rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> list[Softmax]:
    """One model for each value of ``l2``; ``features`` is an array, ``label`` counts from 0.

    The table is scanned once for each step of the slowest setting, so it should be a written one.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), F.col(weight).cast("double").alias("w"))
    centre, width, total, correlations = _spread(rows)
    runs = {k: _minimise(np.zeros((classes, len(centre) + 1)), rounds, tolerance, _curvature(correlations, classes, l2[k])) for k in range(len(l2))}
    points = {k: next(run) for k, run in runs.items()}
    done: dict[int, Softmax] = {}
    while points:
        asked = {}
        for k, (loss, gradient) in _evaluate(rows, points, centre, width).items():
            free = points[k].copy()
            free[:, -1] = 0  # constants are not held down
            try:
                asked[k] = runs[k].send((loss / total + 0.5 * l2[k] * (free * free).sum(), gradient / total + l2[k] * free))
            except StopIteration as end:
                best, value, n = end.value
                done[k] = Softmax(best, centre, width, value, n)
        points = asked
    return [done[k] for k in sorted(done)]


def with_probabilities(df: DataFrame, model: Softmax, features: str = "features", out: str = "probabilities") -> DataFrame:
    """Adds the probability of each class as an array, by column expressions."""
    scaled = model.weights[:, :-1] / model.width
    constants = model.weights[:, -1] - scaled @ model.centre
    x = F.col(features).cast("array<double>")
    logits = F.array(*[
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(float(c)), lambda a, b: a + b) for row, c in zip(scaled, constants)
    ])
    # an element of a one-element array is computed once
    shifted = F.transform(F.array(logits), lambda l: F.transform(l, lambda v: F.exp(v - F.array_max(l))))[0]  # noqa: E741
    return df.withColumn(out, F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0])
