"""Subsets, samples and splits that are the same however the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagshift.operators.norms import scalar
from tagshift.operators.ordered import ordered_scan


def hash_key(*parts: Column) -> Column:
    """Hexadecimal digest that orders rows at random but repeatably."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_int(*parts: Column) -> Column:
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("long")


#: bins of one pass over the keys, and rows that are few enough to be put in order
BINS, FEW = 4096, 10_000


def least_n(df: DataFrame, key: str, tie: str, n: int) -> DataFrame:
    """The n rows with the least ``key``, a long; among equal keys those with the least ``tie``.

    No task and no driver gets the n rows: counts of keys in equal bins, at most ``BINS`` of them, tell which bin the cut falls into, and passes over that
    bin's keys narrow it until it holds few rows or one key. Rows below it are filtered, those in it are ranked by an ordered scan.
    """
    if n <= 0:
        return df.limit(0)
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if ends.n <= n:
        return df.where(F.col(key).isNotNull())
    lo, hi, below, held = ends.lo, ends.hi, 0, ends.n
    while held > FEW and lo < hi:
        width = (hi - lo) // BINS + 1
        # whole numbers only: a quotient of doubles could fall into the next bin
        counts = df.where(F.col(key).between(lo, hi)).groupBy(F.expr(f"({key} - {lo}L) div {width}L").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for bin_, count in sorted((r["bin"], r["n"]) for r in counts):
            if below + count >= n:
                break
            below += count
        lo, hi, held = lo + bin_ * width, min(hi, lo + (bin_ + 1) * width - 1), count
    at_cut = ordered_scan(df.where(F.col(key).between(lo, hi)).select(key, tie), [key, tie], rank="_rank").where(F.col("_rank") < n - below)
    return df.where(F.col(key) < lo).unionByName(df.join(at_cut.select(key, tie), [key, tie], "left_semi"))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The n rows with the least event ids."""
    keyed = df.withColumn("_key", F.col("event_id").cast("long"))
    return least_n(keyed, "_key", "event_id", n).drop("_key")


def random_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n distinct rows, those whose hash is least."""
    keyed = df.withColumn("_h", hash_key(F.col("event_id"), F.lit(seed))).withColumn("_key", hash_int(F.col("event_id"), F.lit(seed)))
    return least_n(keyed, "_key", "_h", n).drop("_h", "_key")


def draw_with_replacement(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n independent uniform draws of rows: the drawn rows with their ``draw`` number."""
    ranked = ordered_scan(df, ["event_id"])
    size = scalar(df.agg(F.count(F.lit(1)).alias("n")), "n")
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (hash_int(F.col("id"), F.lit(seed)) % size).alias("rank")
    )
    return draws.join(ranked, "rank").drop("rank")


def modular_split(df: DataFrame, numerator: int = 2, denominator: int = 3, offset: int = 0) -> DataFrame:
    """Adds ``split``: rows in id order go to training while (row + offset) mod denominator < numerator."""
    ranked = ordered_scan(df, ["event_id"], rank="_row")
    train = F.pmod(F.col("_row") + offset, F.lit(denominator)) < numerator
    return ranked.withColumn("split", F.when(train, "train").otherwise("valid")).drop("_row")


def hashed_split(df: DataFrame, numerator: int = 2, denominator: int = 3) -> DataFrame:
    """As ``modular_split`` with the row number replaced by a hash of the id: no ordering needed."""
    train = F.pmod(F.xxhash64("event_id"), F.lit(denominator)) < numerator
    return df.withColumn("split", F.when(train, "train").otherwise("valid"))


def shuffled_split(df: DataFrame, label: str, train_fraction: float = 0.7, seed: int = 0) -> DataFrame:
    """Adds ``split``: the first floor(fraction x n) rows of each class in hash order train."""
    keyed = df.withColumn("_h", hash_key(F.col("event_id"), F.lit(seed)))
    ranked = ordered_scan(keyed, ["_h", "event_id"], by=[label], rank="_row")
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(train_fraction)).alias("_cut"))
    out = ranked.join(sizes, label)
    return out.withColumn("split", F.when(F.col("_row") < F.col("_cut"), "train").otherwise("valid")).drop("_h", "_row", "_cut")


def quantile_buckets(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Adds ``bucket`` 1..buckets of equal size in order of ``value``, larger buckets first."""
    ranked = ordered_scan(df, [value, "event_id"], rank="_r")
    n = scalar(df.agg(F.count(F.lit(1)).alias("n")), "n")
    t = ranked.withColumn("_n", n).withColumn("_b", F.expr(f"_n div {buckets}")).withColumn("_x", F.col("_n") % buckets)
    wide = F.col("_x") * (F.col("_b") + 1)
    number = F.when(F.col("_r") < wide, F.expr("_r div (_b + 1)")).otherwise(
        F.col("_x") + F.expr("(_r - _x * (_b + 1)) div greatest(_b, 1)")
    )
    return t.withColumn("bucket", (number + 1).cast("long")).drop("_r", "_n", "_b", "_x")


def exact_quantiles(df: DataFrame, value: str, tie: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """(by, probability, quantile) with linear interpolation, read off the global ranks.

    Only the two rows around each quantile leave the ordered table.
    """
    ranked = ordered_scan(df.select(*by, value, tie), [value, tie], by=by, rank="_r")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    at = sizes.select(
        *by, F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"), "_n"
    ).withColumn("_at", F.col("probability") * (F.col("_n") - 1))
    wanted = at.select(
        *by, "probability", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_r")
    )
    hits = ranked.join(wanted, [*by, "_r"])
    lower = F.min_by(value, "_r")
    upper = F.max_by(value, "_r")
    part = F.max(F.col("_at") - F.floor("_at"))
    return hits.groupBy(*by, "probability").agg((lower + (upper - lower) * part).alias("quantile"))
