"""Streams that are broken off and restarted, and what they leave untouched."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tagshift.catalog import streams as ST
from tagshift.sources import fixtures as fx
from tagshift.sources import tables as T
from tagshift.sources.store import materialize, new_path
from tagshift.streaming.conversion import convert_new_files, converted


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return materialize(ST.raw_events(spark, sf_dir), "raw")


def test_a_job_that_dies_between_write_and_commit(spark, raw):
    root = new_path(spark, "broken")
    run = lambda **k: convert_new_files(spark, f"{root}/raw", f"{root}/out", f"{root}/progress", ST.prepared, ST.OUTPUTS, **k)
    seen, died = [], []

    def die(number):
        seen.append(number)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("killed")

    for k in range(3):
        T.append(raw.where(F.col("event_id") % 3 == k).coalesce(1), f"{root}/raw")
        if k == 1:
            with pytest.raises(Exception, match="killed"):
                run(after_write=die)
        run(after_write=die)
    assert died == [1] and seen.count(1) == 2
    whole = ST.prepared(raw)
    got, want = converted(spark, f"{root}/out", "features"), whole.drop("others")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    sums = converted(spark, f"{root}/out", "counts").agg(F.sum("n"), F.sum("sumw")).first()
    assert sums[0] == want.count() and sums[1] == pytest.approx(want.agg(F.sum("weight")).first()[0])
    assert converted(spark, f"{root}/out", "other_jets").count() == 12 * want.count()


def test_a_batch_without_events_that_pass(spark, raw):
    root = new_path(spark, "none")
    soft = F.transform("all", lambda j: j.withField("pt", F.lit(1.0)))
    T.append(raw.withColumn("all", soft), f"{root}/raw")
    convert_new_files(spark, f"{root}/raw", f"{root}/out", f"{root}/progress", ST.prepared, ST.OUTPUTS)
    assert all(converted(spark, f"{root}/out", n).count() == 0 for n in ST.OUTPUTS)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_only_touched_groups_are_written(spark, sf_dir):
    root = new_path(spark, "touched")
    wide = materialize(fx.wide_events(spark, sf_dir).where("tag = '4b' AND region IN ('CR', 'SR')"), "wide")
    ST.deliver_histograms(spark, root, wide.where("event_id % 2 = 0"))
    at = f"{root}/catalogue".removeprefix("file://")
    before = {r: files(f"{at}/region={r}") for r in ("CR", "SR")}
    ST.deliver_histograms(spark, root, wide.where("event_id % 2 = 1 AND region = 'SR'"))
    assert files(f"{at}/region=CR") == before["CR"] and not files(f"{at}/region=SR") & before["SR"]

    def breaks(table, path):
        """Removes a group and dies before the new one is in place."""
        shutil.rmtree(f"{at}/region=CR")
        raise RuntimeError("killed")

    rest = wide.where("event_id % 2 = 1 AND region = 'CR'")
    with pytest.raises(Exception, match="killed"):
        ST.deliver_histograms(spark, root, rest, breaks)
    ST.deliver_histograms(spark, root, rest.where("event_id < 0"))
    got = spark.read.parquet(f"{root}/catalogue").select("region", "variable", "bin", "entries", F.round("sumw", 6).alias("sumw"))
    want = ST.count_bins(wide).select("region", "variable", "bin", "entries", F.round("sumw", 6).alias("sumw"))
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_a_delivery_of_many_files_is_one_batch(spark, sf_dir):
    root = new_path(spark, "many")
    wide = materialize(fx.wide_events(spark, sf_dir).where("tag = '4b' AND region IN ('CR', 'SR')"), "wide")
    ST.deliver_histograms(spark, root, wide.repartition(20))
    assert len(files(f"{root}/raw".removeprefix("file://"))) > 8
    assert os.listdir(f"{root}/log".removeprefix("file://")) == ["batch=0"]
