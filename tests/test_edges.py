"""Hand-made edge rows of the models, pairings, histograms and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tagshift.constants import HISTOGRAM_VARIABLES, METHOD_IDS, method_name
from tagshift.functions import fourvec as fv
from tagshift.functions import jets as J
from tagshift.functions import scores as S
from tagshift.functions.pairing import SELECTION, with_pairing
from tagshift.functions.thrust import thrust, thrust_scan
from tagshift.operators import blocks as BL
from tagshift.operators import hist as H
from tagshift.operators import metrics as X
from tagshift.operators import neighbours as NN
from tagshift.operators.norms import transfer_norms
from tagshift.plans import models as M
from tagshift.plans import report as RP
from tagshift.sources import fixtures as fx
from tagshift.sources.logs import read_history
from tagshift.sources.store import materialize, shared_root
from tagshift.sources.tables import optional_columns


def one_event(spark, jets):
    rows = [(1, [(float(p), float(e), float(f), float(p) * math.cosh(e)) for p, e, f in jets])]
    return spark.createDataFrame(rows, "event_id long, jets array<struct<pt:double,eta:double,phi:double,e:double>>")


def test_collinear_jets_have_full_thrust(spark):
    df = one_event(spark, [(50, 0, 0.7), (40, 1, 0.7), (30, -1, 0.7), (20, 2, 0.7)])
    t = df.select(thrust(F.col("jets")).alias("t")).select("t.*").first()
    assert t["value"] == pytest.approx(140)
    assert math.sin(t["phi"] - 0.7) == pytest.approx(0, abs=1e-12)


def test_thrust_is_never_below_a_scan(spark, sf_dir):
    e = fx.jet_events(spark, sf_dir).select(thrust(F.col("jets"))["value"].alias("t"), thrust_scan(F.col("jets"), 720).alias("s"))
    worst = e.agg(F.max(F.col("s") - F.col("t")).alias("over"), F.max((F.col("t") - F.col("s")) / F.col("t")).alias("under")).first()
    assert worst["over"] < 1e-9 and worst["under"] < 1e-4


def test_event_without_allowed_pairing(spark):
    df = one_event(spark, [(50, 0, 0.0), (50, 0, 0.01), (50, 0, 0.02), (50, 0, 0.03)])
    df = J.with_dijets(df.withColumn("m4j", F.lit(300.0)))
    assert with_pairing(df, SELECTION).first()["pairing"] is None
    assert with_pairing(df, SELECTION).where("pairing IS NOT NULL").count() == 0


def test_space_like_vector_has_negative_mass(spark):
    v = fv.Vec(F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(fv.mass(v)).first()[0] == -3.0


def test_wrapped_angle(spark):
    x = spark.range(1).select(fv.wrap_phi(F.lit(0.1) - F.lit(2 * math.pi - 0.1)), fv.unsigned_phi(F.lit(-0.5))).first()
    assert x[0] == pytest.approx(0.2) and x[1] == pytest.approx(2 * math.pi - 0.5)


def test_flat_columns_to_array_and_back(spark):
    cols = {f"{b}{i}": float(10 * k + i) for k, b in enumerate(("jetPt", "jetEta", "jetPhi", "jetEnergy")) for i in range(4)}
    df = J.flat_to_array(spark.createDataFrame([tuple(cols.values())], list(cols)))
    got = df.select(F.col("jets")[2]["phi"], F.col("jets")[3]["e"], J.count_selected(F.col("jets"), 0.5, 12.5)).first()
    assert tuple(got) == (22.0, 33.0, 2)


def test_bin_edges(spark):
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 11.0)], "x double")
    uniform = [r[0] for r in x.select(H.bin_index(F.col("x"), (2, 0.0, 10.0))).collect()]
    edges = [r[0] for r in x.select(H.bin_index(F.col("x"), [0, 5, 10])).collect()]
    closed = [r[0] for r in x.select(H.bin_index(F.col("x"), (2, 0.0, 10.0), closed_last=True)).collect()]
    assert uniform == edges == [0, 1, 2, 3, 3]
    assert closed == [0, 1, 2, 2, 3]


def test_histogram_totals_equal_weight_sum(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    h = H.fill(e, {"sT": ("sT", (7, 300.0, 500.0)), "m4j": ("m4j", [200, 500, 700])}, ["region"])
    total = e.agg(F.sum("weight")).first()[0]
    assert all(r[1] == pytest.approx(total) for r in h.groupBy("variable").agg(F.sum("sumw")).collect())


def test_ratio_is_zero_over_empty_bin(spark):
    n = spark.createDataFrame([("v", 1, 2.0, 4.0), ("v", 2, 3.0, 1.0)], "variable string, bin int, sumw double, sumw2 double")
    rows = {r["bin"]: r for r in H.compare(n, n.where("bin = 1"), []).collect()}
    assert rows[1]["ratio"] == 1.0 and rows[2]["ratio"] == 0.0 and rows[2]["ratio_err"] == 0.0


def test_blocks_take_every_row(spark):
    rows = [(i, "SR", float(i)) for i in range(10)] + [(100 + i, "CR", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "event_id long, region string, sT double")
    got = BL.round_robin_blocks(df, 3).toPandas()
    assert len(got[got.region == "SR"]) == 10 and len(got[got.region == "CR"]) == 11
    assert sorted(got[(got.block == 0) & (got.region == "SR")].event_id) == [0, 3, 6, 9]
    # fewer targets than a block should have: one block of all rows
    assert set(BL.round_robin_blocks(df, 1000).toPandas().block) == {0}


def test_every_target_keeps_its_neighbours(spark, sf_dir):
    cr = fx.events(spark, sf_dir).where("region = 'CR'").select("tag", F.col("event_id").alias("id"), F.col("sT").alias("x"))
    t, s = cr.where("tag = '4b'"), cr.where("tag = '3b'")
    assert NN.knn_by_gap(t, s, 5).groupBy("tgt_id").count().where("count = 5").count() == t.count()
    few = s.orderBy("x").limit(7)
    assert NN.knn_by_gap(t, few, 1).count() == t.count()
    rows = BL.half_step_blocks(s.select(F.col("id").alias("event_id"), F.col("x").alias("sT")))
    assert rows.select("event_id").distinct().count() == s.count()


def test_default_blocks_give_weights(spark, sf_dir):
    e = materialize(fx.events(spark, sf_dir), "events")
    for model in (M.ot_knn(e, 5), M.ot_classifier(e, e.select("event_id", F.col("h").alias("score")))):
        assert model.where("region = 'SR' AND model_weight > 0").count() > 0


def test_report_holds_every_truth_bin(spark, sf_dir):
    e = materialize(fx.wide_events(spark, sf_dir), "wide")
    truth = materialize(RP.truth_histograms(e), "truth")
    inner = H.with_edges(truth.select("region", "variable", "bin", "sumw"), HISTOGRAM_VARIABLES)
    report = RP.model_against_truth(RP.sample_histograms(e, M.long_weights({"benchmark": M.benchmark(e)})), truth)
    assert report.agg(F.sum("num")).first()[0] == pytest.approx(inner.agg(F.sum("sumw")).first()[0])


def test_models_without_four_tag_events(spark, sf_dir):
    e = fx.events(spark, sf_dir).where("tag = '3b' OR region <> 'CR'")
    assert transfer_norms(e).first()["pi"] is None
    assert M.benchmark(e).where("model_weight IS NOT NULL").count() == 0


def test_transport_models_keep_their_sums(spark, sf_dir):
    e = materialize(fx.events(spark, sf_dir), "events")
    n = transfer_norms(e).first()
    for model in (M.ot_knn(e, 5, 50), M.ot_knn(e, 1, 50)):
        sums = {r["region"]: r["s"] for r in model.groupBy("region").agg(F.sum("model_weight").alias("s")).collect()}
        assert sums["SR"] == pytest.approx(n["w3b_SR"] * n["pi"]) and sums["CR"] == pytest.approx(n["w3b_CR"] * n["pi"])
        assert sums["SB"] == 0.0


def test_auc_against_all_pairs(spark):
    rows = [(0.1, 0, 1.0), (0.1, 1, -0.5), (0.4, 0, 2.0), (0.4, 1, 1.5), (0.4, 0, -1.0), (0.8, 1, 2.0), (0.9, 0, 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, h double, y int, weight double")
    neg, pos = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    pair = sum(a[2] * b[2] * (1.0 if b[0] > a[0] else 0.5 if b[0] == a[0] else 0.0) for a in neg for b in pos)
    want = pair / (sum(a[2] for a in neg) * sum(b[2] for b in pos))
    assert X.auc(df, "h", "y").first()["auc"] == pytest.approx(want)
    swapped = df.withColumn("y", 1 - F.col("y"))
    assert X.auc(swapped, "h", "y").first()["auc"] == pytest.approx(1 - want)


def test_bootstrap_interval_holds_the_value(spark, sf_dir):
    e = fx.events(spark, sf_dir).withColumn("y", (F.col("tag") == "4b").cast("int"))
    value = X.auc(e, "h", "y").first()["auc"]
    ci = X.bootstrap_auc(e, "h", "y", "weight", replicates=100).first()
    assert ci["lower"] < value < ci["upper"] and ci["replicates"] == 100


def test_odds_at_one_are_large(spark):
    assert spark.range(1).select(S.odds(F.lit(1.0))).first()[0] == pytest.approx(1 / S.SURE)


def test_missing_columns_are_left_out(spark):
    got = optional_columns(spark.range(2), {"id": "int", "nothing": "double"})
    assert got.dtypes == [("id", "int")]


def test_method_names():
    assert method_name("OT", "pl", k=5) == "HH_OT__pl_pl__K_5"
    assert method_name("OT", "emd_p1_R0_4", k=10) == METHOD_IDS["ot10"]
    assert method_name("FvT", classifier_id="np799_l0_01_e10") == METHOD_IDS["fvt"]
    assert method_name("Comb-FvT", "emd_p1_R0_4", "np799_l0_01_e10") == METHOD_IDS["comb"]
    assert method_name("benchmark") == "benchmark"


def test_intermediates_go_to_the_shared_folder(spark):
    root = shared_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert materialize(spark.range(3), "probe").inputFiles()[0].removeprefix("file://").startswith(root)


def test_log_restart_begins_a_new_record(spark, tmp_path):
    stale = [">> 0/9 << Validation | 9.0 | 9.0 | 9.0 |", "   Training | 8.0 | 8.0 | 8.0 |"]
    live = [f"{x}" for e in range(3) for x in (f">> {e}/9 << Validation | {e}.5 | 1.0 | 0.5 | a | ^ 3.0%", f"   Training | {e}.25 | 1.0 | 0.5 |")]
    (tmp_path / "one.log").write_text("\n".join([*stale, ">> Epoch << Data", *stale, ">> Epoch << Data", *live, "some other line"]))
    (tmp_path / "two.log").write_text("\n".join(live[:3]))
    got = sorted((r["file"][-7:], r["epoch"], r["split"], r["loss"]) for r in read_history(spark, str(tmp_path)).collect())
    assert got == sorted(
        [("one.log", e, k, e + x) for e in range(3) for k, x in (("validation", 0.5), ("training", 0.25))]
        + [("two.log", 0, "validation", 0.5), ("two.log", 0, "training", 0.25), ("two.log", 1, "validation", 1.5)])
