"""Background models, their comparison with the truth, and the classifiers behind them."""

from __future__ import annotations

import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tagshift.catalog.base import CTES, B, R, big, define, query, r, sql
from tagshift.catalog.distances import _DIGITS, BLOCK, neighbours_by_distance
from tagshift.catalog.histograms import _cells, tidy
from tagshift.constants import HISTOGRAM_VARIABLES, METHOD_IDS, PI_4B_LARGE, SIGNAL_SCALE
from tagshift.operators import hist as H
from tagshift.operators import metrics as X
from tagshift.operators import norms as N
from tagshift.operators import split as SP
from tagshift.operators.transport import monotone_coupling_whole
from tagshift.plans import learning as L
from tagshift.plans import models as M
from tagshift.plans import report as RP
from tagshift.plans import softmax as SX
from tagshift.sources import fixtures as fx
from tagshift.sources.store import materialize, materialize_wide, new_path

FOUR_TAG = "tag = '4b'"
_3B = "SELECT event_id, region, weight FROM events4 WHERE tag = '3b'"
define("m_benchmark", ["events4", "norms"], "SELECT event_id, region, weight * pi AS mw FROM events4, norms WHERE tag = '3b'")
define("m_fvt", ["events4", "norms"], "SELECT event_id, region, weight * h / (1 - h) * pi AS mw FROM events4, norms WHERE tag = '3b' AND region IN ('CR', 'SR')")
for _k in (1, 5, 10, 20):
    define(f"m_ot{_k}", ["events4", "norms", "coupling", "blk", f"nnw{_k}"], f"""SELECT e.event_id, e.region, coalesce(s.mw, c.mw, 0) AS mw FROM ({_3B}) e
        LEFT JOIN (SELECT tgt_id, raw * w3b_SR * pi / sum(raw) OVER () AS mw FROM
            (SELECT c.tgt_id, sum(c.value / c.src_mass * coalesce(n.nn_weight, 0)) AS raw FROM coupling c LEFT JOIN nnw{_k} n ON n.src_id = c.src_id GROUP BY c.tgt_id) x, norms) s ON s.tgt_id = e.event_id
        LEFT JOIN (SELECT event_id, raw * w3b_CR * pi / sum(raw) OVER () AS mw FROM
            (SELECT b.event_id, coalesce(n.nn_weight, 0) AS raw FROM blk b LEFT JOIN nnw{_k} n ON n.src_id = b.event_id WHERE b.region = 'CR') y, norms) c ON c.event_id = e.event_id""")
define("m_comb", ["events4", "norms", "coupling", "blk"], f"""SELECT e.event_id, e.region, coalesce(s.mw, c.mw, 0) AS mw FROM ({_3B}) e
    LEFT JOIN (SELECT tgt_id, pi * p / (SELECT max(block) + 1 FROM blk) * w3b_SR AS mw FROM (SELECT c.tgt_id, sum(c.value * h / (1 - h)) AS p FROM coupling c JOIN events4 v ON v.event_id = c.src_id GROUP BY 1) x, norms) s ON s.tgt_id = e.event_id
    LEFT JOIN (SELECT event_id, pi * h / (1 - h) * w / sum(w) OVER (PARTITION BY block) / (SELECT max(block) + 1 FROM blk) * w3b_CR AS mw FROM blk, norms WHERE region = 'CR') c ON c.event_id = e.event_id""")
define("all_weights", ["m_benchmark", "m_fvt", "m_ot5", "m_comb"], " UNION ALL ".join(
    f"SELECT event_id, region, mw, '{METHOD_IDS[k]}' AS method FROM {v}" for k, v in (("benchmark", "m_benchmark"), ("fvt", "m_fvt"), ("ot5", "m_ot5"), ("comb", "m_comb"))))


def events(spark, d):
    """The event table, written once because every model reads it several times."""
    return materialize(fx.events(spark, d), "events")


def scores(e):
    return e.select("event_id", F.col("h").alias("score"))


def _out(m):
    return m.select("event_id", "region", r("model_weight").alias("model_weight"))


def _model_sql(view):
    return sql(view, f"SELECT {B('event_id')} AS event_id, region, {R('mw', 6)} AS model_weight FROM {view}")


@query("i01_benchmark_model", _model_sql("m_benchmark"))
def benchmark_model(spark, d):
    return _out(M.benchmark(materialize(fx.events(spark, d).select("event_id", "tag", "region", "weight"), "labels")))


@query("i02_classifier_model", _model_sql("m_fvt"))
def classifier_model(spark, d):
    e = events(spark, d)
    return _out(M.classifier_odds(e, scores(e)))


def _ot(k):
    def run(spark, d):
        return _out(M.ot_knn(events(spark, d), k, BLOCK))

    return run


for _k in (1, 5, 10, 20):
    query(f"i03_transport_knn_{_k}", _model_sql(f"m_ot{_k}"))(_ot(_k))


@query("i03_transport_knn_distance")
def transport_knn_distance(spark, d):
    """Neighbours by event distance at the design radius, couplings in sT order."""
    e = events(spark, d)
    m = M.ot_knn(e, 5, BLOCK, neighbours=lambda rows: neighbours_by_distance(rows, 5))
    return m.groupBy("region").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("model_weight"), 4).alias("sumw"), big(F.count_if(F.col("model_weight") > 0)).alias("filled")
    )


@query("i04_transport_classifier", _model_sql("m_comb"))
def transport_classifier(spark, d):
    e = events(spark, d)
    return _out(M.ot_classifier(e, scores(e), block_targets=BLOCK))


define("whole_unit", ["events4"], f"SELECT region, power(10, {_DIGITS.format(w='weight')}) AS per_one FROM events4 WHERE tag = '3b' AND weight > 0 GROUP BY region")
define("whole", ["events4", "whole_unit"], """SELECT *, sum(m) OVER (PARTITION BY region ORDER BY sT, event_id ROWS UNBOUNDED PRECEDING) AS upto, sum(m) OVER (PARTITION BY region) AS total
    FROM (SELECT event_id, region, sT, greatest(1, CAST(round(weight * per_one) AS BIGINT)) AS m, h FROM events4 JOIN whole_unit USING (region) WHERE tag = '3b' AND weight > 0) t""")
define("sb_pi", ["events4"], "SELECT count(*) FILTER (WHERE tag = '4b') / count(*) FILTER (WHERE tag = '3b') AS pi FROM events4 WHERE region = 'SB'")


@query("i05_single_coupling_model", sql("whole sb_pi", f"""SELECT {B('event_id')} AS event_id, region, {R('mw', 4)} AS model_weight FROM
    (SELECT event_id, region, 10000 * pi * h / (1 - h) AS mw FROM whole, sb_pi WHERE region = 'SB' UNION ALL
     SELECT t.event_id, t.region, 10000 * max(pi) * sum((least(s.upto * t.total, t.upto * s.total) - greatest((s.upto - s.m) * t.total, (t.upto - t.m) * s.total))::DOUBLE / (s.total * t.total)::DOUBLE * s.h / (1 - s.h)) FROM whole s JOIN whole t ON s.region = 'SB' AND t.region IN ('CR', 'SR')
       AND s.upto * t.total > (t.upto - t.m) * s.total AND t.upto * s.total > (s.upto - s.m) * t.total, sb_pi GROUP BY t.event_id, t.region) x"""))
def single_coupling_model(spark, d):
    e = events(spark, d)
    m = M.single_coupling(e, scores(e))
    return m.select("event_id", "region", r("model_weight", 4).alias("model_weight"))


@query("h11_whole_region_coupling", sql("whole", f"""SELECT {B('src_id')} AS src_id, {B('tgt_id')} AS tgt_id, {R('v', 9)} AS value FROM
    (SELECT s.event_id AS src_id, t.event_id AS tgt_id, (least(s.upto * t.total, t.upto * s.total) - greatest((s.upto - s.m) * t.total, (t.upto - t.m) * s.total))::DOUBLE / (s.total * t.total)::DOUBLE AS v FROM whole s JOIN whole t
     ON s.region = 'CR' AND t.region = 'SR' AND s.upto * t.total > (t.upto - t.m) * s.total AND t.upto * s.total > (s.upto - s.m) * t.total) x"""))
def whole_region_coupling(spark, d):
    rows = events(spark, d).where("tag = '3b'")
    side = lambda g: rows.where(F.col("region") == g).select(F.col("event_id").alias("id"), F.col("sT").alias("x"), F.col("weight").alias("w"))
    return monotone_coupling_whole(side("CR"), side("SR")).select("src_id", "tgt_id", r("value", 9).alias("value"))


def all_models(e):
    """The four models; blocks and their coupling are found once for the two that use them."""
    shared = M.shared_coupling(e, BLOCK)
    return {
        METHOD_IDS["benchmark"]: M.benchmark(e), METHOD_IDS["fvt"]: M.classifier_odds(e, scores(e)),
        METHOD_IDS["ot5"]: M.ot_knn(e, 5, BLOCK, shared=shared), METHOD_IDS["comb"]: M.ot_classifier(e, scores(e), block_targets=BLOCK, shared=shared),
    }


@query("i13_model_registry", sql("all_weights", f"SELECT 'w_' || method AS column_name, region, {B('count(*)')} AS n, {R('sum(mw)', 4)} AS sumw FROM all_weights GROUP BY 1, 2"))
def model_registry(spark, d):
    w = M.long_weights(all_models(events(spark, d)))
    return w.groupBy(F.concat(F.lit("w_"), F.col("method")).alias("column_name"), "region").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("weight"), 4).alias("sumw")
    )


define("weights_wide", ["all_weights", "wide"], "SELECT w.* EXCLUDE (weight), a.mw AS weight, a.method AS method FROM all_weights a JOIN wide w ON w.event_id = a.event_id WHERE w.region IN ('CR', 'SR')")
define("model_hist", ["weights_wide"], f"SELECT method AS sample, region, variable, bin, sum(w) AS den, sqrt(sum(w * w)) AS den_err FROM ({_cells('weights_wide', 'true', 'method, region')}) c GROUP BY 1, 2, 3, 4")
define("truth_hist", ["wide"], f"SELECT region, variable, bin, {PI_4B_LARGE} * sum(w) AS num, {PI_4B_LARGE} * sqrt(sum(w * w)) AS num_err FROM ({_cells('wide', FOUR_TAG)}) c GROUP BY 1, 2, 3")
_BINS = "(VALUES " + ", ".join(f"('{n}', {H.bin_count(b)})" for n, (_, b) in HISTOGRAM_VARIABLES.items()) + ") nb(variable, n)"


define("bench_wide", ["m_benchmark", "wide"], "SELECT w.* EXCLUDE (weight), a.mw AS weight FROM m_benchmark a JOIN wide w ON w.event_id = a.event_id WHERE w.region IN ('CR', 'SR')")
define("bench_hist", ["bench_wide"], f"SELECT 'benchmark' AS sample, region, variable, bin, sum(w) AS den, sqrt(sum(w * w)) AS den_err FROM ({_cells('bench_wide')}) c GROUP BY 1, 2, 3, 4")


def _against_truth_sql(view):
    return sql(f"{view} truth_hist", f"""SELECT m.sample, m.region, m.variable, {B('m.bin')} AS bin, {R('den', 4)} AS model, {R('num', 5)} AS truth,
      {R('CASE WHEN den <> 0 THEN num / den ELSE 0 END', 5)} AS ratio,
      {R('CASE WHEN den <> 0 THEN sqrt((num_err / den) ** 2 + (den_err * num / (den * den)) ** 2) ELSE 0 END', 5)} AS ratio_err
    FROM (SELECT g.*, coalesce(m.den, 0) AS den, coalesce(m.den_err, 0) AS den_err, coalesce(t.num, 0) AS num, coalesce(t.num_err, 0) AS num_err FROM
      (SELECT sample, region, variable, unnest(range(1, n + 1)) AS bin FROM (SELECT DISTINCT sample FROM {view}) s,
         (SELECT region FROM {view} UNION SELECT region FROM truth_hist WHERE region IN ('CR', 'SR')) r, {_BINS}) g
      LEFT JOIN {view} m ON m.sample = g.sample AND m.region = g.region AND m.variable = g.variable AND m.bin = g.bin
      LEFT JOIN truth_hist t ON t.region = g.region AND t.variable = g.variable AND t.bin = g.bin) m""")


def _against_truth(e, weights):
    models, truth = materialize_wide(RP.sample_histograms(e, weights), "model_bins"), materialize_wide(RP.truth_histograms(e, PI_4B_LARGE), "truth_bins")
    out = RP.model_against_truth(models, truth)
    return out.select(
        "sample", "region", "variable", big("bin").alias("bin"), r("den", 4).alias("model"), r("num", 5).alias("truth"),
        r("ratio", 5).alias("ratio"), r("ratio_err", 5).alias("ratio_err"),
    )


@query("i14_benchmark_against_truth", _against_truth_sql("bench_hist"))
def benchmark_against_truth(spark, d):
    e = materialize_wide(fx.wide_events(spark, d), "wide")
    return _against_truth(e, M.long_weights({"benchmark": M.benchmark(e)}))


@query("i14_model_against_truth", _against_truth_sql("model_hist"))
def model_against_truth(spark, d):
    e = materialize_wide(fx.wide_events(spark, d), "wide")
    return _against_truth(e, M.long_weights(all_models(e)))


# the views of the events once more, for the signal sample
_CHAIN = ["vec", "events4", "dij", "quad", "pair_sel", "near", "wide"]
define("signal_ev", ["ev"], "SELECT event_id, " + ", ".join(f"1.25 * pt{i} AS pt{i}, 0.6 * eta{i} AS eta{i}, phi{i}, m{i}" for i in range(4)) + " FROM ev")
for _name in _CHAIN:
    _renamed = lambda x: re.sub(r"\b(FROM|JOIN) (ev|" + "|".join(_CHAIN) + r")\b", r"\1 signal_\2", x)
    define(f"signal_{_name}", [f"signal_{n}" for n in CTES[_name][0]], _renamed(CTES[_name][1]))
define("base_samples", ["wide", "signal_wide"], f"""SELECT * EXCLUDE (weight), weight, 'h4b' AS sample FROM wide WHERE {FOUR_TAG} AND event_id % 3 = 0
    UNION ALL SELECT * EXCLUDE (weight), weight * {PI_4B_LARGE}, 'h4b_large' FROM wide WHERE {FOUR_TAG}
    UNION ALL SELECT * EXCLUDE (weight), weight / 100 * {SIGNAL_SCALE}, 'h_sig' FROM signal_wide""")


@query("i14_base_histograms", sql("base_samples", f"""SELECT region, sample, variable, {B('bin')} AS bin, {B('count(*)')} AS entries, {R('sum(w)', 4)} AS sumw, {R('sum(w * w)', 4)} AS sumw2
    FROM ({_cells('base_samples', "region IN ('CR', 'SR')", 'region, sample')}) c GROUP BY region, sample, variable, bin"""))
def base_histograms(spark, d):
    """What models are compared with: a small and a large 4b sample, and the signal."""
    truth = materialize(fx.wide_events(spark, d).where(FOUR_TAG), "truth")
    signal = fx.widened(fx.signal_events(spark, d))
    h = RP.base_histograms({"h4b": (truth.where("event_id % 3 = 0"), 1.0), "h4b_large": (truth, PI_4B_LARGE), "h_sig": (signal, SIGNAL_SCALE)})
    return tidy(h, ("region", "sample"))


@query("d19_weight_diagnostics", sql("m_ot5", f"""SELECT region, {R('sum(mw)', 4)} AS total, {R('max(mw)', 5)} AS largest, {R('avg(CASE WHEN mw <> 0 THEN 1.0 ELSE 0 END)', 6)} AS filled,
    {B('count(DISTINCT round(mw, 5))')} AS different FROM m_ot5 GROUP BY region"""))
def weight_diagnostics(spark, d):
    m = M.ot_knn(events(spark, d), 5, BLOCK)
    return m.groupBy("region").agg(
        r(F.sum("model_weight"), 4).alias("total"), r(F.max("model_weight"), 5).alias("largest"),
        r(F.avg((F.col("model_weight") != 0).cast("double"))).alias("filled"), big(F.count_distinct(F.round("model_weight", 5))).alias("different"),
    )


@query("f01_score_alignment", sql("events4", f"SELECT {B('event_id')} AS event_id, region, {R('h', 3)} AS score FROM events4 WHERE region IN ('CR', 'SR')"))
def score_alignment(spark, d):
    """Scores joined back by key; a count check would reveal a missing or doubled score."""
    e = events(spark, d)
    rows = e.where(F.col("region").isin("CR", "SR")).select("event_id", "region")
    joined = rows.join(scores(e), "event_id")
    return joined.select("event_id", "region", r("score", 3).alias("score"))


@query("f09_weights_side_by_side", sql("m_benchmark m_fvt m_comb", f"""SELECT {B('f.event_id')} AS event_id, {R('b.mw', 6)} AS w_benchmark, {R('f.mw', 6)} AS w_fvt, {R('c.mw', 6)} AS w_comb
    FROM m_fvt f JOIN m_benchmark b ON b.event_id = f.event_id JOIN m_comb c ON c.event_id = f.event_id WHERE f.region = 'SR'"""))
def weights_side_by_side(spark, d):
    e = events(spark, d)
    models = {"w_benchmark": M.benchmark(e), "w_fvt": M.classifier_odds(e, scores(e)), "w_comb": M.ot_classifier(e, scores(e), block_targets=BLOCK)}
    out = e.where("tag = '3b' AND region = 'SR'").select("event_id")
    for name, m in models.items():
        out = out.join(m.select("event_id", r("model_weight").alias(name)), "event_id")
    return out


@query("b12_model_weight_range", sql("m_fvt m_comb", f"""SELECT {B('f.event_id')} AS event_id, {R('f.mw', 6)} AS w_fvt, {R('c.mw', 6)} AS w_comb
    FROM m_fvt f JOIN m_comb c ON c.event_id = f.event_id WHERE f.region = 'SR' AND c.mw > 0 AND c.mw < 0.3"""))
def model_weight_range(spark, d):
    e = events(spark, d)
    f = M.classifier_odds(e, scores(e)).where("region = 'SR'").select("event_id", F.col("model_weight").alias("w_fvt"))
    c = M.ot_classifier(e, scores(e), block_targets=BLOCK).select("event_id", F.col("model_weight").alias("w_comb"))
    return f.join(c.where((F.col("w_comb") > 0) & (F.col("w_comb") < 0.3)), "event_id").select("event_id", r("w_fvt").alias("w_fvt"), r("w_comb").alias("w_comb"))


define("sr_pair", ["m_fvt", "m_comb", "events4"], """SELECT f.event_id, e.svb, round(f.mw, 9) AS f, round(c.mw, 9) AS c, round(f.mw - c.mw, 9) AS x
    FROM m_fvt f JOIN m_comb c ON c.event_id = f.event_id JOIN events4 e ON e.event_id = f.event_id WHERE f.region = 'SR'""")


def _sr_pair(spark, d):
    """Classifier and combined weights of the 3b SR events, with the signal score."""
    e = events(spark, d)
    f = M.classifier_odds(e, scores(e)).where("region = 'SR'").select("event_id", F.col("model_weight").alias("_f"))
    c = M.ot_classifier(e, scores(e), block_targets=BLOCK).select("event_id", F.col("model_weight").alias("_c"))
    both = f.join(c, "event_id").join(e.select("event_id", "svb"), "event_id")
    return materialize(both.select("event_id", "svb", F.round("_f", 9).alias("f"), F.round("_c", 9).alias("c"), F.round(F.col("_f") - F.col("_c"), 9).alias("x")), "pair")


@query("d10_model_weight_plane", sql("sr_pair", f"""SELECT {B('x')} AS x_bin, {B('y')} AS y_bin, {B('count(*)')} AS entries FROM
    (SELECT CASE WHEN f = f1 THEN 30 ELSE floor((f - f0) * 30 / (f1 - f0)) + 1 END AS x, CASE WHEN c = c1 THEN 30 ELSE floor((c - c0) * 30 / (c1 - c0)) + 1 END AS y
     FROM (SELECT f, c, min(f) OVER () AS f0, max(f) OVER () AS f1, min(c) OVER () AS c0, max(c) OVER () AS c1 FROM sr_pair) a) b GROUP BY 1, 2"""))
def model_weight_plane(spark, d):
    """30 x 30 bins over the observed ranges of classifier and combined weights, upper edges included."""
    e = _sr_pair(spark, d)
    ends = e.agg(*[g(c).alias(f"{n}_{c}") for c in ("f", "c") for n, g in (("lo", F.min), ("hi", F.max))])

    def index(c):
        lo, hi = N.scalar(ends, f"lo_{c}"), N.scalar(ends, f"hi_{c}")
        return F.when(F.col(c) == hi, 30).otherwise(F.floor((F.col(c) - lo) * 30 / (hi - lo)) + 1)

    return e.select(big(index("f")).alias("x_bin"), big(index("c")).alias("y_bin")).groupBy("x_bin", "y_bin").agg(big(F.count(F.lit(1))).alias("entries"))


@query("e07_weight_differences", sql("sr_pair", f"""SELECT {B('q')} AS bucket, {B('count(*)')} AS n, {R('quantile_cont(x, 0.25)', 6)} AS lower,
    {R('quantile_cont(x, 0.5)', 6)} AS median, {R('quantile_cont(x, 0.75)', 6)} AS upper FROM (SELECT ntile(4) OVER (ORDER BY svb, event_id) AS q, x FROM sr_pair) t GROUP BY q"""))
def weight_differences(spark, d):
    """Classifier minus combined weight in the quartiles of the signal score."""
    b = materialize(SP.quantile_buckets(_sr_pair(spark, d).select("event_id", "svb", "x"), "svb", 4), "buckets")
    q = SP.exact_quantiles(b, "x", "event_id", ["bucket"], [0.25, 0.5, 0.75])
    wide = q.groupBy("bucket").agg(*[
        r(F.max(F.when(F.col("probability") == p, F.col("quantile")))).alias(n) for n, p in (("lower", 0.25), ("median", 0.5), ("upper", 0.75))
    ])
    return wide.join(b.groupBy("bucket").agg(big(F.count(F.lit(1))).alias("n")), "bucket")


# ---- Spark ML: no SQL twin ----


def features(spark, d):
    return materialize_wide(L.with_label(L.with_features(fx.events(spark, d))), "features")


def fvt_training(f):
    return N.training_weights(f)


def svb_training(spark, d, f):
    """Background and signal in CR and SR, the signal scaled to the sum of the background."""
    columns = ["event_id", "region", "weight", "features", "label", "train_weight"]
    used = F.col("region").isin("CR", "SR")
    b = f.where(used).withColumn("label", F.lit(0)).withColumn("train_weight", F.col("weight"))
    s = L.with_features(fx.signal_events(spark, d).where(used)).withColumn("label", F.lit(1))
    s = N.signal_to_background(s, b).withColumnRenamed("scaled", "train_weight")
    return b.select(*columns).unionByName(s.select(*columns))


def _parts(rows):
    """Rows to fit on, and the others, which alone are reported."""
    s = materialize(SP.hashed_split(rows), "split")
    return s.where("split = 'train'"), s.where("split = 'valid'")


def _quality(scored):
    """Per region: events, mean score and the AUC of the score."""
    scored = materialize(scored.select("event_id", "region", "label", "weight", "score"), "scored")
    means = scored.groupBy("region").agg(big(F.count(F.lit(1))).alias("n"), r(F.avg("score"), 4).alias("mean_score"))
    return means.join(X.auc(scored, "score", "label", "weight", keys=["region"]), "region").withColumn("auc", r("auc", 4))


@query("k01_logistic_classifier")
def logistic_classifier(spark, d):
    fit, rest = _parts(features(spark, d))
    return _quality(L.score(L.train(fvt_training(fit), "logistic"), rest))


@query("k01_signal_classifier")
def signal_classifier(spark, d):
    fit, rest = _parts(svb_training(spark, d, features(spark, d)))
    return _quality(L.score(L.train(fit, "logistic"), rest))


@query("k02_batch_scores")
def batch_scores(spark, d):
    f = features(spark, d)
    return L.score(L.train(fvt_training(_parts(f)[0]), "boosted"), f).select("event_id", "region", r("score", 4).alias("score"))


@query("k03_symmetric_scores")
def symmetric_scores(spark, d):
    fit, rest = _parts(features(spark, d))
    m = L.train(fvt_training(fit), "logistic")
    s = L.symmetric_score(m, rest.select("event_id", "m4j", "jets"))
    return _quality(rest.select("event_id", "region", "label", "weight").join(s, "event_id"))


@query("k04_random_forest")
def random_forest(spark, d):
    fit, rest = _parts(features(spark, d))
    return _quality(L.score(L.train(fvt_training(fit), "forest"), rest))


@query("k05_saved_model")
def saved_model(spark, d):
    """Scores of the stored and reloaded model against the fitted one."""
    f = features(spark, d)
    m = L.train(fvt_training(f), "logistic")
    path = new_path(spark, "model")
    L.save(m, path)
    a = L.score(m, f).select("event_id", "score")
    b = L.score(L.load(path), f).select("event_id", F.col("score").alias("again"))
    return a.join(b, "event_id").agg(big(F.count(F.lit(1))).alias("n"), F.max(F.abs(F.col("score") - F.col("again"))).alias("largest_gap"))


@query("k06_setting_sweep")
def setting_sweep(spark, d):
    t = materialize(SP.modular_split(fvt_training(features(spark, d))), "split")
    grid = [("logistic", {"regParam": 0.0}), ("logistic", {"regParam": 0.1}), ("forest", {"maxDepth": 3}), ("boosted", {"maxDepth": 2})]
    out = L.sweep(t.where("split = 'train'"), t.where("split = 'valid'"), grid)
    return out.select("classifier", "setting", r("train_auc", 4).alias("train_auc"), r("valid_auc", 4).alias("valid_auc"))


@query("i06_forest_models")
def forest_models(spark, d):
    """The classifier model and the transported classifier model with forest scores."""
    f = features(spark, d)
    s = materialize(L.score(L.train(fvt_training(f), "forest"), f).select("event_id", "score"), "scores")
    both = M.long_weights({"HH_RF": M.classifier_odds(f, s), "HH_Comb_RF": M.ot_classifier(f, s, block_targets=BLOCK)})
    return both.groupBy("method", "region").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("weight"), 2).alias("sumw"))


@query("i15_validation_classifier")
def validation_classifier(spark, d):
    """A forest that tries to tell model-weighted 3b from 4b in SR, judged on rows it was not fitted on.

    An AUC of one half is closure.
    """
    f = features(spark, d)
    fit, rest = _parts(RP.validation_set(f, M.benchmark(f)).withColumn("train_weight", F.col("weight")))
    return _quality(L.score(L.train(fit, "forest"), rest))


@query("i15_validation_by_model", sql("all_weights", f"SELECT method, {B('count(*)')} AS n, {R('sum(mw)', 3)} AS sumw, true AS judged FROM all_weights WHERE region = 'SR' GROUP BY method"))
def validation_by_model(spark, d):
    """The validation classifier for every model: SR events weighted by it, told from 4b by a classifier judged on other rows."""
    f = features(spark, d)
    out = None
    for name, model in all_models(f).items():
        model = materialize(model, "model")
        fit, rest = _parts(RP.validation_set(f, model).withColumn("train_weight", F.col("weight")))
        quality = _quality(L.score(L.train(fit, "logistic"), rest))
        n = model.where("region = 'SR'").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("model_weight"), 3).alias("sumw"))
        row = n.select(F.lit(name).alias("method"), "n", "sumw", quality.select(F.col("auc").between(0.0, 1.0) & (F.col("n") > 0)).scalar().alias("judged"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- four classes on signed weights ----

_CLASSES = ("d4", "d3", "t4", "t3")
define("classed", ["events4"], "SELECT event_id, signed_weight AS w, (CASE WHEN event_id % 4 = 0 THEN 't' ELSE 'd' END) || (CASE WHEN tag = '4b' THEN '4' ELSE '3' END) AS class FROM events4")


def classed_features(spark, d):
    """Events of data (d) and of a simulated sample (t), tagged 4 and 3, with an array of features and weights of either sign."""
    e = L.with_features(fx.events(spark, d)).select("event_id", "tag", F.col("signed_weight").alias("train_weight"), vector_to_array("features").alias("features"))
    name = F.concat(F.when(F.col("event_id") % 4 == 0, "t").otherwise("d"), F.when(F.col("tag") == "4b", "4").otherwise("3"))
    number = F.array_position(F.array(*[F.lit(c) for c in _CLASSES]), F.col("class")) - 1
    return materialize_wide(e.withColumn("class", name).withColumn("label", number).drop("tag"), "classed")


@query("k01_four_classes", sql("classed", f"SELECT class, {B('count(*)')} AS n, {R('sum(w)', 4)} AS sumw, true AS share_found FROM classed GROUP BY class"))
def four_classes(spark, d):
    """At the least loss the weighted probabilities of a class add up to its weight, also where weights are negative."""
    f = classed_features(spark, d)
    # held down enough that few events with negative weights cannot pull a coefficient without end
    (model,) = SX.train(f, len(_CLASSES), [0.1])
    p = SX.with_probabilities(f, model).select("class", "train_weight", F.posexplode("probabilities").alias("k", "p"))
    names = F.array(*[F.lit(c) for c in _CLASSES])
    found = p.groupBy(F.get(names, F.col("k")).alias("class")).agg(F.sum(F.col("train_weight") * F.col("p")).alias("found"), F.sum("train_weight").alias("all"))
    given = f.groupBy("class").agg(big(F.count(F.lit(1))).alias("n"), F.sum("train_weight").alias("sumw"))
    return given.join(found, "class").select("class", "n", r("sumw", 4).alias("sumw"), (F.abs(F.col("found") - F.col("sumw")) <= 1e-4 * F.col("all")).alias("share_found"))


_HOLD = [0.0, 0.01, 0.1, 1.0]


@query("k06_sweep_in_one_scan", "SELECT * FROM (VALUES " + ", ".join(f"({x!r}::DOUBLE, true, true)" for x in _HOLD) + ") t(l2, better_than_none, loss_rises_with_l2)")
def sweep_in_one_scan(spark, d):
    """All settings are trained in the same scans; holding coefficients down costs loss, but less than having none."""
    f = classed_features(spark, d).withColumn("train_weight", F.abs("train_weight"))
    *models, held = SX.train(f, len(_CLASSES), [*_HOLD, 1e6], rounds=25)
    none = held.loss
    losses = [m.loss for m in models]
    rows = [(h, bool(x <= none + 1e-6), bool(k == 0 or x >= losses[k - 1] - 1e-4)) for k, (h, x) in enumerate(zip(_HOLD, losses))]
    return spark.createDataFrame(rows, "l2 double, better_than_none boolean, loss_rises_with_l2 boolean")
