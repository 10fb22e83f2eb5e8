"""Whitening against plain arithmetic on whole numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from __spark_entry__ import queries
from tagshift.llm import whitening


def expected(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    return n, off, cov


def check(rows, vectors, components):
    """``vectors``: id -> vector of every row that stays."""
    n, off, cov = expected(list(vectors.values()))
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == len(vectors) * min(components, len(cov))
    by = {(r[0], r.component): r for r in rows}
    assert len(by) == len(rows)
    for k in range(1, min(components, len(cov)) + 1):
        own = np.array([by[i, k].whitened for i in vectors])
        want = np.array(off, float) / n @ axes[:, k - 1] / math.sqrt(values[k - 1])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
    for i, o in zip(vectors, off):
        r = by[i, 1]
        assert r.n == n and r.deviation == sum(v * v for v in o)
        assert math.isclose(r.explained, values[0] / np.trace(cov), rel_tol=1e-9) and r.identity_error < 1e-9


def test_given_embeddings(spark, sf_dir):
    rows = queries()["op11_whitening"](spark, sf_dir).collect()
    check(rows, {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}, 8)


@pytest.mark.parametrize("bits", [1, 5, 21, 63])
def test_popcounts_are_products(bits):
    rng = np.random.default_rng(bits)
    u = rng.integers(0, 1 << bits, (130, 3), dtype=np.uint64)
    total = np.zeros((3, 3, 2 * bits - 1), np.int64)
    whitening.add_popcounts(total, whitening.planes(u, bits))
    for i in range(3):
        for j in range(i, 3):
            assert sum(int(c) << s for s, c in enumerate(total[i, j])) == sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j]))


def test_odd_rows_go(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(c) for c in rng.normal(size=3)] for i in range(40)}
    good[7] = [300.0, -90.0, 2.5]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in [*good.items(), *odd]], "vec_id long, embedding array<double>, component int, whitened double").repartition(5)
    check(whitening.whiten(df, "vec_id", "embedding").collect(), good, 8)


def test_wide_entries_stay_exact(spark):
    good = {0: [4e15, 1.0], 1: [-4e15, 2.0], 2: [1.0, 5.0], 3: [7e14, -3.0]}
    df = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, "vec_id", "embedding", 1).collect()
    n, off, cov = expected(list(good.values()))
    assert all(r.deviation is None for r in rows)
    assert math.isclose(rows[0].explained, np.linalg.eigvalsh(cov)[-1] / np.trace(cov), rel_tol=1e-12) and rows[0].identity_error < 1e-9


def test_no_spread_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], schema), "vec_id", "embedding").collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 3 for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 3.0])], schema), "vec_id", "embedding").collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-9
    none = whitening.whiten(spark.createDataFrame([(1, None)], schema), "vec_id", "embedding")
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
