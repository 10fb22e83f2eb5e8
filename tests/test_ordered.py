"""Ordered scans, splits and interpolation, with a hot key that holds a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagshift.operators.metrics import interpolated
from tagshift.operators.ordered import ordered_scan
from tagshift.operators.split import draw_with_replacement, exact_quantiles, hashed_split, least_n, quantile_buckets, random_n


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.xxhash64("id") % 1000) / 10.0)
    return spark.range(3000).select(
        F.col("id").alias("event_id"), hot.alias("x"), (F.col("id") % 5).alias("g"), ((F.col("id") % 7) - 2).cast("double").alias("w")
    ).cache()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_and_running_sum(rows, by):
    got = ordered_scan(rows, ["x", "event_id"], by=by, running={"before": "w"})
    w = W.partitionBy(*by).orderBy("x", "event_id")
    want = got.withColumn("r", F.row_number().over(w) - 1).withColumn("s", F.sum("w").over(w) - F.col("w"))
    assert want.where((F.col("r") != F.col("rank")) | (F.abs(F.col("s") - F.col("before")) > 1e-9)).count() == 0
    assert got.count() == rows.count()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_neighbours_in_order(rows, by):
    rows = rows.withColumn("some", F.when(F.col("event_id") % 50 == 0, F.col("event_id")))
    got = ordered_scan(rows, ["x", "event_id"], by=by, following={"next": "some"}, previous={"last": "x"})
    w = W.partitionBy(*by).orderBy("x", "event_id")
    want = got.withColumn("n", F.first("some", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("l", F.lag("x").over(w))
    assert got.count() == rows.count()
    assert want.where("NOT (n <=> next) OR NOT (l <=> last)").count() == 0


def test_rank_only(rows):
    got = ordered_scan(rows.select("event_id", "x"), ["x", "event_id"]).orderBy("rank").toPandas()
    assert (got["rank"].to_numpy() == np.arange(len(got))).all()
    assert got.sort_values(["x", "event_id"])["rank"].is_monotonic_increasing


def test_hot_key_is_spread(rows):
    """Rows of the hot value end up in several range partitions."""
    parts = rows.repartitionByRange(4, "x", "event_id").where("x = 7.0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_empty_input(rows):
    assert ordered_scan(rows.where("event_id < 0"), ["x", "event_id"], running={"b": "w"}).count() == 0


def test_quantiles_match_numpy(rows):
    got = {(x["g"], x["probability"]): x["quantile"] for x in exact_quantiles(rows, "x", "event_id", ["g"], [0.1, 0.5, 0.99]).collect()}
    pdf = rows.toPandas()
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(pdf[pdf.g == g].x, p))
    assert len(got) == 15


def test_buckets_match_ntile(rows):
    got = quantile_buckets(rows, "x", 7).withColumn("n", F.ntile(7).over(W.orderBy("x", "event_id")))
    assert got.where("n != bucket").count() == 0


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 20_000, 33_334, 59_999, 60_000, 70_000])
def test_least_rows(spark, n):
    """A third of the keys are equal, the others far apart."""
    df = spark.range(60_000, numPartitions=7).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id") % 1_000_000_007).cast("long").alias("key"))
    got = sorted((r.key, r.id) for r in least_n(df, "key", "id", n).collect())
    assert got == sorted((r.key, r.id) for r in df.collect())[:n]


def test_least_rows_pass_no_single_task(rows):
    plan = least_n(rows.select("event_id", F.col("event_id").alias("key")), "key", "event_id", 700)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert least_n(rows.where("event_id < 0").withColumn("key", F.col("event_id")), "key", "event_id", 5).count() == 0


def test_samples(rows):
    assert random_n(rows, 100, 1).select("event_id").distinct().count() == 100
    drawn = draw_with_replacement(rows, 5000, 1)
    assert drawn.count() == 5000 and drawn.select("event_id").distinct().count() < 3000
    share = hashed_split(rows).where("split = 'train'").count() / 3000
    assert 0.6 < share < 0.73


def test_interpolation_extends(spark):
    curve = spark.createDataFrame([(0.2, 1.0), (0.4, 3.0), (0.8, 3.0)], "x double, y double")
    points = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.4), (4, 1.0)], "id long, x double")
    got = {r["id"]: r["y_at"] for r in interpolated(points, curve).collect()}
    assert got == pytest.approx({1: -1.0, 2: 2.0, 3: 3.0, 4: 3.0})
