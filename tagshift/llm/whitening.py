"""Embedding whitening from an exact bit-sliced scatter matrix.

Each entry c becomes the whole number x = floor(scale * c) + offset. Less the smallest x of its
dimension it is a short unsigned number; its bit planes are packed across the rows of a batch into
64-bit words. The cross-product of two dimensions is the sum over their planes p and q of
2^(p + q) times the number of rows that have both bits, which is one AND and one popcount per word.
Tasks return counts by (dimension, dimension, p + q); Spark adds them up, and the driver, which gets
at most D (D + 1) / 2 * (2 b - 1) counts for D dimensions of b bits whatever the number of rows,
weights and centres them as whole numbers of any size, so the covariance is rounded once per entry.

Three scans of the vectors follow each other (sums, planes, check of the result), then rows are whitened where they
are read; nothing is shuffled but the counts.

Defined cases: rows whose vector is null, or holds a null, a NaN, an infinity or an entry whose x lies
beyond 2^62, are dropped. So are vectors of another length than most (of two equally frequent lengths the longer
counts), as they lie in another space; empty vectors have no dimension. Repeated rows count and come back as often as
they occur, and a null id stays null. A component without spread (its eigenvalue is no more than rounding, as with a
single row, equal rows or fewer rows than dimensions) has ``whitened`` null and is left out of ``identity_error``;
``explained`` is null where no dimension has spread. ``deviation`` is null where it exceeds a long. Other columns are not read, so
their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagshift.llm.base import query

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
_REACH = 2.0**62  # of scaled entries
_LONG = 2**63 - 1
_MEASURES = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vectors(df: DataFrame, vector: str, scale: int, offset: int, ident: str | None = None) -> DataFrame:
    """Usable rows as (id, x), x being an array of whole numbers of one length."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    usable = F.coalesce(F.forall(entries, lambda c: F.coalesce(F.abs(c) * scale < _REACH, F.lit(False))), F.lit(False)) & (F.size(entries) > 0)
    own = F.col(f"`{ident}`") if ident else F.lit(None)
    kept = df.select(own.alias("id"), entries.alias("entries")).where(usable)
    lengths = kept.groupBy(F.size("entries").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("entries", lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long"))
    return kept.where(F.size("entries") == (first.d if first else 0)).select("id", x.alias("x"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, smallest, largest and sum of each dimension's x over a task; sums in two halves, which cannot overflow."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        new = [len(x), x.min(axis=0), x.max(axis=0), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
        held = new if held is None else [held[0] + new[0], np.minimum(held[1], new[1]), np.maximum(held[2], new[2]), held[3] + new[3], held[4] + new[4]]
    if held is not None:
        d = len(held[1])
        arrays = [np.arange(d), np.full(d, held[0]), *held[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["dim", "n", "lo", "hi", "upper", "lower"])


def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the columns of ``u`` as words of 64 rows: shape (dimensions, bits, words)."""
    rows, d = u.shape
    padded = np.zeros((d, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = u.T
    out = np.empty((d, bits, padded.shape[1] // 64), np.uint64)
    for p in range(bits):
        out[:, p] = np.packbits((padded >> np.uint64(p)).astype(np.uint8) & 1, axis=1).view(np.uint64)
    return out


def add_popcounts(total: np.ndarray, sliced: np.ndarray) -> None:
    """Adds to ``total[i, j, p + q]``, for j >= i, the number of rows with bit p of i and bit q of j."""
    d, bits, words = sliced.shape
    for i in range(d):
        rest = sliced[i:].reshape(-1, words)
        for p in range(bits):
            both = np.bitwise_count(sliced[i, p] & rest).sum(axis=1, dtype=np.int64)
            total[i, i:, p : p + bits] += both.reshape(d - i, bits)


def scatter(x: DataFrame, lo: list[int], bits: int) -> dict[tuple[int, int], int]:
    """Exact sums of products of the shifted numbers, for dimensions i <= j."""
    base = np.array(lo, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(base), len(base), 2 * bits - 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                # the difference of two longs fits an unsigned one
                add_popcounts(total, planes(_matrix(batch.column(0)).astype(np.uint64) - base.astype(np.uint64), bits))
        i, j, s = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.int32()), pa.array(total[i, j, s])], ["i", "j", "s", "n"])

    counts = x.select("x").mapInArrow(count, "i int, j int, s int, n long").groupBy("i", "j", "s").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, int], int] = {}
    for i, j, s, n in zip(*[c.to_pylist() for c in counts.toArrow().columns]):
        out[i, j] = out.get((i, j), 0) + (n << s)
    return out


class Fit:
    """What rows are whitened with: centre as (n, sums of shifted numbers), components by falling eigenvalue."""

    def __init__(self, x: DataFrame, components: int):
        rows = x.select("x").mapInArrow(_moments, "dim long, n long, lo long, hi long, upper long, lower long").groupBy("dim").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")],
        ).orderBy("dim").collect()
        self.n = rows[0].n if rows else 0
        if not rows:
            return
        d = len(rows)
        self.lo = [r.lo for r in rows]
        # sums of x less the smallest
        self.sums = [(int(r.upper) << 32) + int(r.lower) - self.n * r.lo for r in rows]
        spread = max(r.hi - r.lo for r in rows)
        #: whether n * (largest difference), squared and added over the dimensions, stays a long
        self.narrow = d * (self.n * max(spread, 1)) ** 2 < 2**62
        products = scatter(x, self.lo, max(spread.bit_length(), 1))
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (self.n * products.get((i, j), 0) - self.sums[i] * self.sums[j]) / self.n**2
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(v))
        self.values, self.axes = values[order], axes[:, order]
        self.spread = self.values > 8 * d * np.finfo(float).eps * max(trace, 0.0)
        self.explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in self.values]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S by row and dimension, exact: longs where they and their squares fit, else Python's whole numbers."""
        if self.narrow:
            return (x - np.array(self.lo)) * self.n - np.array(self.sums, np.int64)
        return (x.astype(object) - np.array(self.lo, object)) * self.n - np.array(self.sums, object)

    def project(self, off: np.ndarray) -> np.ndarray:
        """Whitened coordinates by row and component; components without spread are left at 0."""
        scale = np.where(self.spread, np.sqrt(np.where(self.spread, self.values, 1.0)), np.inf)
        return (off / self.n).astype(float) @ self.axes / scale


def identity_error(x: DataFrame, fit: Fit) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, from a scan of the rows."""
    k = len(fit.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = fit.project(fit.deviations(_matrix(batch.column(0))))
                sums += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(sums.ravel())], ["i", "j", "v"])

    table = np.zeros((k, k + 1))
    for r in x.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        table[r.i, r.j] = r.v
    mean = table[:, k] / fit.n
    off = (table[:, :k] / fit.n - np.outer(mean, mean) - np.eye(k))[np.ix_(fit.spread, fit.spread)]
    return float(np.abs(off).max()) if off.size else None


def whiten(
    df: DataFrame, ident: str, vector: str, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """One row per usable row and component: the id, and what ``_MEASURES`` names."""
    x = vectors(df, vector, scale, offset, ident)
    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), *T._parse_datatype_string(f"struct<{_MEASURES}>").fields])
    fit = Fit(x, components)
    if not fit.n:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(x, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            off = fit.deviations(_matrix(batch.column(1)))
            far = [int(v) if v <= _LONG else None for v in (off * off).sum(axis=1)]
            spread = np.tile(fit.spread, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fit.n), pa.int64()), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(fit.project(off).ravel(), mask=~spread), pa.array(fit.explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()),
                ],
                names=schema.names,
            )

    return x.mapInArrow(run, schema)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
