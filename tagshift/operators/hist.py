"""Weighted histograms as long tables: one row per (keys, variable, bin).

Bins count from 1; bin 0 holds underflow and bin n + 1 overflow. Bins are closed on the left and
open on the right, unless ``closed_last`` asks for a last bin that also takes its upper edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Binning = list | tuple


def bin_count(binning: Binning) -> int:
    return len(binning) - 1 if isinstance(binning, list) else binning[0]


def edges(binning: Binning) -> list[float]:
    if isinstance(binning, list):
        return [float(e) for e in binning]
    n, lo, hi = binning
    return [lo + i * (hi - lo) / n for i in range(n + 1)]


def bin_index(x: Column, binning: Binning, closed_last: bool = False) -> Column:
    """Bin number of ``x``; null stays null."""
    n = bin_count(binning)
    if isinstance(binning, list):
        index = sum(((x >= F.lit(float(e))).cast("int") for e in binning[1:]), (x >= F.lit(float(binning[0]))).cast("int"))
        last = float(binning[-1])
    else:
        _, lo, hi = binning
        raw = F.floor((x - F.lit(float(lo))) * F.lit(float(n)) / F.lit(float(hi - lo))) + 1
        index = F.greatest(F.lit(0), F.least(F.lit(n + 1), raw))
        last = float(hi)
    if closed_last:
        index = F.when(x == F.lit(last), n).otherwise(index)
    return index.cast("int")


def fill(
    df: DataFrame,
    variables: dict[str, tuple[str | Column, Binning]],
    keys: list[str],
    weight: str | Column = "weight",
    scale: float = 1.0,
    closed_last: bool = False,
) -> DataFrame:
    """All histograms in one scan and one small shuffle: (keys, variable, bin, entries, sumw, sumw2)."""
    cells = [bin_index(F.expr(x) if isinstance(x, str) else x, binning, closed_last) for x, binning in variables.values()]
    names = F.array(*[F.lit(name) for name in variables])
    w = (F.col(weight) if isinstance(weight, str) else weight) * F.lit(float(scale))
    return (
        df.select(*keys, w.alias("_w"), F.posexplode(F.array(*cells)).alias("_v", "bin"))
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "_v", "bin")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.sum("_w").alias("sumw"),
            F.sum(F.col("_w") * F.col("_w")).alias("sumw2"),
        )
        .select(*keys, F.get(names, F.col("_v")).alias("variable"), "bin", "entries", "sumw", "sumw2")
    )


def fill_2d(
    df: DataFrame, x: Column, y: Column, x_bins: Binning, y_bins: Binning, keys: list[str], weight: Column | None = None
) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return (
        df.select(*keys, bin_index(x, x_bins).alias("x_bin"), bin_index(y, y_bins).alias("y_bin"), w.alias("_w"))
        .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy(*keys, "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum("_w").alias("sumw"))
    )


def edge_table(spark: SparkSession, variables: dict[str, tuple[str | Column, Binning]]) -> DataFrame:
    """(variable, bin, lo, hi) for the given binnings: a few hundred rows, fixed by the binnings."""
    rows = [
        (name, i + 1, e[i], e[i + 1])
        for name, (_, binning) in variables.items()
        for e in [edges(binning)]
        for i in range(len(e) - 1)
    ]
    return spark.createDataFrame(rows, "variable STRING, bin INT, lo DOUBLE, hi DOUBLE")


def with_edges(hist: DataFrame, variables: dict[str, tuple[str | Column, Binning]]) -> DataFrame:
    """Inner bins only, with their edges; the broadcast side is the fixed edge table."""
    return hist.join(F.broadcast(edge_table(hist.sparkSession, variables)), ["variable", "bin"])


def errors(hist: DataFrame, norm: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds ``n`` and ``error`` = sqrt(sum of squared weights), optionally scaled to a total of ``norm``."""
    out = hist.withColumn("n", F.col("sumw")).withColumn("error", F.sqrt("sumw2"))
    if norm is None:
        return out
    total = F.sum("sumw").over(W.partitionBy(*(keys or []), "variable"))
    return out.withColumn("n", F.try_divide("n", total) * F.lit(float(norm))).withColumn(
        "error", F.try_divide("error", total) * F.lit(float(norm))
    )


def unit_area(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Content per total of the inner bins, and density = that divided by the bin width."""
    share = F.try_divide("sumw", F.sum("sumw").over(W.partitionBy(*keys, "variable")))
    return hist.withColumn("share", share).withColumn("density", share / (F.col("hi") - F.col("lo")))


def ratio(n: Column, d: Column, dn: Column, dd: Column) -> tuple[Column, Column]:
    """Bin ratio and its error; both are 0 where the denominator is empty."""
    filled = d.isNotNull() & (d != 0)
    err = F.sqrt((dn / d) * (dn / d) + (dd * n / (d * d)) * (dd * n / (d * d)))
    return F.when(filled, n / d).otherwise(0.0), F.when(filled, err).otherwise(0.0)


def compare(numerator: DataFrame, denominator: DataFrame, keys: list[str]) -> DataFrame:
    """Joins two histogram tables bin by bin and adds the ratio with its error."""
    on = [*keys, "variable", "bin"]
    n = numerator.select(*on, F.col("sumw").alias("num"), F.sqrt("sumw2").alias("num_err"))
    d = denominator.select(*on, F.col("sumw").alias("den"), F.sqrt("sumw2").alias("den_err"))
    joined = n.join(d, on, "full").fillna(0.0, ["num", "num_err", "den", "den_err"])
    value, err = ratio(F.col("num"), F.col("den"), F.col("num_err"), F.col("den_err"))
    return joined.withColumn("ratio", value).withColumn("ratio_err", err)
