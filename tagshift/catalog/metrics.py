"""ROC, AUC and its intervals, thresholds, calibration and other classifier diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, define, query, r, sql
from tagshift.constants import SCALER_OVERRIDES
from tagshift.functions import jets as J
from tagshift.functions import scores as S
from tagshift.operators import metrics as X
from tagshift.operators import split as SP
from tagshift.operators.ordered import ordered_scan
from tagshift.sources import fixtures as fx
from tagshift.sources.store import materialize

define("labelled", ["events4"], "SELECT *, CASE WHEN tag = '4b' THEN 1 ELSE 0 END AS y FROM events4")
define("by_score", ["labelled"], """SELECT h, sum(CASE WHEN y = 0 THEN weight ELSE 0 END) AS w0, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS w1,
    sum(CASE WHEN y = 0 THEN signed_weight ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN signed_weight ELSE 0 END) AS s1,
    sum(1 - y) AS n0, sum(y) AS n1 FROM labelled GROUP BY h""")
define("roc", ["by_score"], """SELECT h, sum(w0) OVER (ORDER BY h DESC) / sum(w0) OVER () AS fpr, sum(w1) OVER (ORDER BY h DESC) / sum(w1) OVER () AS tpr FROM by_score""")
define("split4", ["labelled"], "SELECT *, CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 3 < 2 THEN 'train' ELSE 'valid' END AS split FROM labelled")


def labelled(spark, d):
    return fx.events(spark, d).select(
        "event_id", "region", "weight", "signed_weight", "h", "svb", "sT", F.when(F.col("tag") == "4b", 1).otherwise(0).alias("y")
    )


@query("d13_calibration", sql("labelled", f"""SELECT class, {R('mean_p', 8)} AS mean_p, {R('expected', 8)} AS expected, {R('expected / mean_p', 8)} AS scale FROM
    (SELECT '4b' AS class, sum(weight * h) / sum(weight) AS mean_p, sum(weight * y) / sum(weight) AS expected FROM labelled WHERE region = 'CR'
     UNION ALL SELECT '3b', sum(weight * (1 - h)) / sum(weight), sum(weight * (1 - y)) / sum(weight) FROM labelled WHERE region = 'CR') t"""))
def calibration(spark, d):
    c = X.calibration(labelled(spark, d).where("region = 'CR'"), "y", "h", "weight")
    return c.select("class", *[r(x, 8).alias(x) for x in ("mean_p", "expected", "scale")])


@query("d14_closure", sql("labelled", f"""SELECT {R('b', 4)} AS norm_b, {R('w4 / b', 8)} AS d4_over_b FROM
    (SELECT sum(CASE WHEN y = 0 THEN weight * h / (1 - h) END) AS b, sum(CASE WHEN y = 1 THEN weight END) AS w4 FROM labelled) t"""))
def closure(spark, d):
    c = X.closure(labelled(spark, d), "y", "h", "weight")
    return c.select(r("norm_b", 4).alias("norm_b"), r("d4_over_b", 8).alias("d4_over_b"))


@query("d15_cross_entropy", sql("labelled", f"SELECT region, {R('sum(-weight * ln(CASE WHEN y = 1 THEN h ELSE 1 - h END)) / sum(weight)', 8)} AS loss FROM labelled GROUP BY region"))
def cross_entropy(spark, d):
    e = labelled(spark, d)
    return e.groupBy("region").agg(r(F.sum(F.col("weight") * S.log_loss_term(F.col("y"), F.col("h"))) / F.sum("weight"), 8).alias("loss"))


@query("d16_accuracy", sql("labelled", f"""SELECT region, {R('sum(CASE WHEN (h >= 0.5) = (y = 1) THEN weight ELSE 0 END) / sum(weight)', 8)} AS weighted,
    {R('avg(CASE WHEN (h >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END)', 8)} AS plain FROM labelled GROUP BY region"""))
def accuracy(spark, d):
    right = (S.hard_label(F.col("h")) == F.col("y")).cast("double")
    return labelled(spark, d).groupBy("region").agg(
        r(F.sum(right * F.col("weight")) / F.sum("weight"), 8).alias("weighted"), r(F.avg(right), 8).alias("plain")
    )


@query("d17_cut_working_point", sql("labelled signal", f"""SELECT
    {R("(SELECT sum(CASE WHEN region = 'SR' THEN weight ELSE 0 END) / sum(weight) FROM signal)", 8)} AS signal_rate,
    {R("(SELECT sum(CASE WHEN region <> 'SR' THEN weight ELSE 0 END) / sum(weight) FROM labelled)", 8)} AS background_rate"""))
def cut_working_point(spark, d):
    rate = lambda df, c, n: df.agg((F.sum(F.when(c, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(n))
    s = rate(fx.signal(spark, d), F.col("region") == "SR", "signal_rate")
    b = rate(labelled(spark, d), F.col("region") != "SR", "background_rate")
    return s.select(r("signal_rate", 8).alias("signal_rate"), r(b.scalar(), 8).alias("background_rate"))


_PROBS = [0.025, 0.25, 0.5, 0.75, 0.975]


@query("d20_exact_quantiles", sql("events4", f"""SELECT region, {R('p', 4)} AS probability, {R('q', 6)} AS quantile FROM
    (SELECT region, unnest({_PROBS}) AS p, unnest(quantile_cont(sT, {_PROBS})) AS q FROM events4 GROUP BY region) t"""))
def exact_quantiles(spark, d):
    q = SP.exact_quantiles(fx.events(spark, d).select("region", "sT", "event_id"), "sT", "event_id", ["region"], _PROBS)
    return q.select("region", r("probability", 4).alias("probability"), r("quantile").alias("quantile"))


@query("d21_feature_scaling", sql("dij", f"""SELECT {R('avg(sT)', 6)} AS mean_sT, {R('stddev_pop(sT)', 6)} AS std_sT, {R('avg(m4j)', 4)} AS mean_m4j,
    {R('stddev_pop(m4j)', 4)} AS std_m4j, {R('avg((m01 - 130) / 100)', 6)} AS mean_scaled_m01, {R('avg(eta0 / 2.4)', 8)} AS mean_scaled_eta0,
    {R('avg((dR01 - pi() / 2) / (pi() / 2))', 8)} AS mean_scaled_dr01 FROM dij"""))
def feature_scaling(spark, d):
    def scaled(x, kind):
        mean, width = SCALER_OVERRIDES[kind]
        return (x - F.lit(mean)) / F.lit(width)

    e = J.with_dijets(fx.events(spark, d))
    return e.agg(
        r(F.avg("sT")).alias("mean_sT"), r(F.stddev_pop("sT")).alias("std_sT"),
        r(F.avg("m4j"), 4).alias("mean_m4j"), r(F.stddev_pop("m4j"), 4).alias("std_m4j"),
        r(F.avg(scaled(F.col("m01"), "dijet_mass"))).alias("mean_scaled_m01"),
        r(F.avg(scaled(F.col("jets")[0]["eta"], "eta")), 8).alias("mean_scaled_eta0"),
        r(F.avg(scaled(F.col("dR01"), "dijet_dr")), 8).alias("mean_scaled_dr01"),
    )


@query("e06_cumulative_by_score", sql("by_score", f"""SELECT {R('h', 3)} AS score, {R('sum(s0) OVER (ORDER BY h)', 5)} AS cum0, {R('sum(s1) OVER (ORDER BY h)', 5)} AS cum1 FROM by_score"""))
def cumulative_by_score(spark, d):
    c = X.cumulative_scores(labelled(spark, d), "h", "y", "signed_weight")
    return c.select(r("score", 3).alias("score"), r(F.col("below0") + F.col("w0"), 5).alias("cum0"), r(F.col("below1") + F.col("w1"), 5).alias("cum1"))


@query("e07_quartile_differences", sql("labelled", f"""SELECT {B('q')} AS bucket, {B('count(*)')} AS n, {R('quantile_cont(x, 0.25)', 6)} AS lower,
    {R('quantile_cont(x, 0.5)', 6)} AS median, {R('quantile_cont(x, 0.75)', 6)} AS upper FROM
    (SELECT ntile(4) OVER (ORDER BY svb, event_id) AS q, h - svb AS x FROM labelled WHERE region = 'SR' AND y = 0) t GROUP BY q"""))
def quartile_differences(spark, d):
    e = labelled(spark, d).where("region = 'SR' AND y = 0").select("event_id", "svb", (F.col("h") - F.col("svb")).alias("x"))
    b = SP.quantile_buckets(e, "svb", 4)
    q = SP.exact_quantiles(b, "x", "event_id", ["bucket"], [0.25, 0.5, 0.75])
    wide = q.groupBy("bucket").agg(*[
        r(F.max(F.when(F.col("probability") == p, F.col("quantile")))).alias(n) for n, p in (("lower", 0.25), ("median", 0.5), ("upper", 0.75))
    ])
    return wide.join(b.groupBy("bucket").agg(big(F.count(F.lit(1))).alias("n")), "bucket")


@query("e11_best_threshold", sql("roc", f"""SELECT {R('h', 3)} AS threshold, {R('sigma', 6)} AS sigma FROM
    (SELECT h, s / sqrt(s + b + 2.5) AS sigma FROM (SELECT h, CASE WHEN tpr < 0.1 THEN 0 ELSE tpr * 700 END AS s,
        CASE WHEN fpr < 0.001 THEN 1e9 ELSE fpr * 7000 END AS b FROM roc) t) u ORDER BY sigma DESC, h DESC LIMIT 1"""))
def best_threshold(spark, d):
    roc = X.roc_curve(labelled(spark, d), "h", "y")
    return X.best_threshold(roc, F.lit(700.0), F.lit(7000.0)).select(r("threshold", 3).alias("threshold"), r("sigma").alias("sigma"))


@query("f11_placements", sql("by_score", f"""SELECT {R('h', 3)} AS score, {R('ny - c1 + 0.5 * n1', 3)} AS v_x, {R('c0 - n0 + 0.5 * n0', 3)} AS v_y FROM
    (SELECT h, n0, n1, sum(n1) OVER () AS ny, sum(n1) OVER (ORDER BY h) AS c1, sum(n0) OVER (ORDER BY h) AS c0 FROM by_score) t"""))
def placements(spark, d):
    """Per score: positives above it and negatives below it, ties counting one half."""
    c = X.cumulative_scores(labelled(spark, d), "h", "y", None)
    total = c.agg(F.sum("w1").alias("ny"))
    return c.select(
        r("score", 3).alias("score"), r(total.scalar() - F.col("below1") - 0.5 * F.col("w1"), 3).alias("v_x"),
        r(F.col("below0") + 0.5 * F.col("w0"), 3).alias("v_y"),
    )


@query("j01_roc_curve", sql("roc", f"SELECT {R('h', 3)} AS threshold, {R('fpr', 8)} AS fpr, {R('tpr', 8)} AS tpr FROM roc"))
def roc_curve(spark, d):
    c = X.roc_curve(labelled(spark, d), "h", "y")
    return c.select(r("threshold", 3).alias("threshold"), r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


_AUC = "sum({w1} * (c0 - {w0} + 0.5 * {w0})) / (sum({w0}) * sum({w1}))"


@query("j02_auc_negative_weights", sql("by_score", f"""SELECT {R(_AUC.format(w0='s0', w1='s1'), 10)} AS auc FROM (SELECT *, sum(s0) OVER (ORDER BY h) AS c0 FROM by_score) t"""))
def auc_negative_weights(spark, d):
    return X.auc(labelled(spark, d), "h", "y", "signed_weight").select(r("auc", 10).alias("auc"))


@query("j02_auc_by_region", sql("labelled", f"""SELECT region, {R(_AUC.format(w0='s0', w1='s1'), 10)} AS auc FROM (SELECT *, sum(s0) OVER (PARTITION BY region ORDER BY h) AS c0 FROM
    (SELECT region, h, sum(CASE WHEN y = 0 THEN signed_weight ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN signed_weight ELSE 0 END) AS s1 FROM labelled GROUP BY 1, 2) g) t GROUP BY region"""))
def auc_by_region(spark, d):
    return X.auc(labelled(spark, d), "h", "y", "signed_weight", keys=["region"]).select("region", r("auc", 10).alias("auc"))


@query("j02_auc_document_quality", f"""WITH s AS (SELECT n_chars AS h, sum(1 - quality) AS s0, sum(quality) AS s1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
    SELECT {R(_AUC.format(w0='s0', w1='s1'), 10)} AS auc FROM (SELECT *, sum(s0) OVER (ORDER BY h) AS c0 FROM s) t""")
def auc_document_quality(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    joined = docs.join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return X.auc(joined, "n_chars", "quality", None).select(r("auc", 10).alias("auc"))


_COUNT = " + ".join(f"CASE WHEN u >= {q!r} THEN 1 ELSE 0 END" for q in X.POISSON)


@query("j03_auc_bootstrap", sql("labelled", f"""SELECT {R('quantile_cont(auc, 0.025)', 6)} AS lower, {R('quantile_cont(auc, 0.975)', 6)} AS upper, {B('count(auc)')} AS replicates FROM
    (SELECT k, sum(p * (below + 0.5 * n)) / (sum(n) * sum(p)) AS auc FROM
      (SELECT k, n, p, coalesce(sum(n) OVER (PARTITION BY k ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
        (SELECT k, h, sum(CASE WHEN y = 0 THEN c * signed_weight ELSE 0 END) AS n, sum(CASE WHEN y = 1 THEN c * signed_weight ELSE 0 END) AS p FROM
          (SELECT k, h, y, signed_weight, {_COUNT} AS c FROM
            (SELECT k, h, y, signed_weight, (b * b % 2147483647 + a * 40692) % 2147483647 / 2147483647 AS u FROM
              (SELECT *, (a * a % 2147483647 * 69621 + i + k) % 2147483647 AS b FROM
                (SELECT *, (i * 48271 + k * 16807 + 12345) % 2147483647 AS a FROM
                  (SELECT h, y, signed_weight, CAST(event_id AS BIGINT) % 2147483647 AS i, CAST(k AS BIGINT) AS k FROM labelled, range(1, 1001) ks(k)) v) w) x) z) t GROUP BY k, h) g) q GROUP BY k) s"""))
def auc_bootstrap(spark, d):
    out = X.bootstrap_auc(labelled(spark, d), "h", "y", "signed_weight", replicates=1000)
    return out.select(r("lower").alias("lower"), r("upper").alias("upper"), big("replicates").alias("replicates"))


_PLACED = """SELECT *, nx * 1.0 AS fx, ny * 1.0 AS fy, ny - c1 + 0.5 * n1 AS vx, c0 - n0 + 0.5 * n0 AS vy FROM (SELECT h, n0, n1, sum(n0) OVER () AS nx, sum(n1) OVER () AS ny,
    sum(n1) OVER (ORDER BY h) AS c1, sum(n0) OVER (ORDER BY h) AS c0 FROM (SELECT h, CAST(n0 AS DOUBLE) AS n0, CAST(n1 AS DOUBLE) AS n1 FROM by_score) b) t"""
define("placed", ["by_score"], _PLACED)
_Z = "1.959963984540054"


@query("j04_bamber_interval", sql("placed", f"""SELECT {R('auc', 8)} AS auc, {R('auc - ' + _Z + ' * sqrt(v)', 8)} AS lower, {R('auc + ' + _Z + ' * sqrt(v)', 8)} AS upper FROM
    (SELECT auc, (1 + (nx - 1) * bx + (ny - 1) * by_ - 4 * (nx + ny - 1) * (auc - 0.5) ** 2) / (4 * (nx - 1) * (ny - 1)) AS v FROM
      (SELECT max(fx) AS nx, max(fy) AS ny, sum(n1 * vy) / (max(fx) * max(fy)) AS auc,
         sum(n1 * ((fx - vy) * (fx - vy - 1) + vy * (vy - 1) - 2 * (fx - vy) * vy)) / (max(fx) * (max(fx) - 1) * max(fy)) AS bx,
         sum(n0 * ((fy - vx) * (fy - vx - 1) + vx * (vx - 1) - 2 * (fy - vx) * vx)) / (max(fy) * (max(fy) - 1) * max(fx)) AS by_ FROM placed) a) b"""))
def bamber(spark, d):
    return X.bamber_interval(labelled(spark, d), "h", "y").select(*[r(c, 8).alias(c) for c in ("auc", "lower", "upper")])


@query("j05_hanley_mcneil_interval", sql("placed", f"""SELECT {R('auc', 8)} AS auc, {R('auc - ' + _Z + ' * sqrt(v)', 8)} AS lower, {R('auc + ' + _Z + ' * sqrt(v)', 8)} AS upper FROM
    (SELECT auc, (auc * (1 - auc) - 0.25 * p + (ny - 1) * (q1 - auc * auc) + (nx - 1) * (q2 - auc * auc)) / ((nx - 1) * (ny - 1)) AS v FROM
      (SELECT max(fx) AS nx, max(fy) AS ny, sum(n1 * vy) / (max(fx) * max(fy)) AS auc, sum(n0 * n1) / (max(fx) * max(fy)) AS p,
         sum(n0 * vx * vx) / (max(fx) * max(fy) * max(fy)) AS q1, sum(n1 * vy * vy) / (max(fx) * max(fx) * max(fy)) AS q2 FROM placed) a) b"""))
def hanley_mcneil(spark, d):
    return X.hanley_mcneil_interval(labelled(spark, d), "h", "y").select(*[r(c, 8).alias(c) for c in ("auc", "lower", "upper")])


@query("j06_scaled_significance", sql("roc by_score", f"""SELECT {R('h', 3)} AS threshold, {R('sigma', 6)} AS sigma, {R('s', 4)} AS S, {R('b', 4)} AS B FROM
    (SELECT h, s, b, s / sqrt(s + b + 2.5) AS sigma FROM (SELECT h,
        CASE WHEN tpr < 0.1 THEN 0 ELSE tpr * (SELECT sum(w1) FROM by_score) * 140 / 59.6 END AS s,
        CASE WHEN fpr < 0.001 THEN 1e9 ELSE fpr * (SELECT sum(w0) FROM by_score) * 140 / 59.6 END AS b FROM roc) t) u ORDER BY sigma DESC, h DESC LIMIT 1"""))
def scaled_significance(spark, d):
    e = labelled(spark, d)
    sums = e.agg(F.sum(F.when(F.col("y") == 1, F.col("weight"))).alias("s"), F.sum(F.when(F.col("y") == 0, F.col("weight"))).alias("b"))
    best = X.best_threshold(X.roc_curve(e, "h", "y"), sums.select("s").scalar(), sums.select("b").scalar(), luminosity_ratio=140 / 59.6)
    return best.select(r("threshold", 3).alias("threshold"), r("sigma").alias("sigma"), r("S", 4).alias("S"), r("B", 4).alias("B"))


def _curve(split: str) -> str:
    return f"""SELECT round(fpr, 12) AS x, max(tpr) AS y FROM (SELECT sum(w0) OVER (ORDER BY h DESC) / sum(w0) OVER () AS fpr, sum(w1) OVER (ORDER BY h DESC) / sum(w1) OVER () AS tpr
        FROM (SELECT h, sum(CASE WHEN y = 0 THEN weight ELSE 0 END) AS w0, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS w1 FROM split4 WHERE split = '{split}' GROUP BY h) g) c GROUP BY 1"""


define("curve_t", ["split4"], _curve("train"))
define("curve_v", ["split4"], _curve("valid"))
define("curve_at", ["curve_t", "curve_v"], """SELECT t.x, t.y, v.y0 + (v.y1 - v.y0) * (t.x - v.x0) / (v.x1 - v.x0) AS y_at FROM
    (SELECT t.*, greatest(0, least((SELECT count(*) FROM curve_v v WHERE v.x <= t.x) - 1, (SELECT count(*) FROM curve_v) - 2)) AS k FROM curve_t t) t
    JOIN (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, row_number() OVER (ORDER BY x) - 1 AS k FROM curve_v) v ON t.k = v.k""")


def _split_curves(spark, d):
    s = SP.modular_split(labelled(spark, d).select("event_id", "h", "y", "weight"))
    s = materialize(s, "split")
    part = lambda n: s.where(F.col("split") == n)
    curve = lambda n: X.roc_curve(part(n), "h", "y").withColumn("fpr", F.round("fpr", 12))
    return part("train"), curve("train"), curve("valid")


@query("f07_curve_interpolation", sql("curve_at", f"SELECT {R('x', 8)} AS fpr, {R('y_at', 6)} AS tpr_valid FROM curve_at"))
def curve_interpolation(spark, d):
    _, train, valid = _split_curves(spark, d)
    t = ordered_scan(X.step_tops(train), ["x"])
    at = X.interpolated(t.select(F.col("rank").alias("id"), "x"), X.step_tops(valid))
    return at.select(r("x", 8).alias("fpr"), r("y_at").alias("tpr_valid"))


@query("j07_overtraining", sql("curve_at split4", f"""SELECT {R('a', 8)} AS area, {R('100 * a / (a + greatest(auc - 0.5, 0))', 5)} AS percent FROM
    (SELECT sum((x1 - x) * (g + g1) / 2) AS a FROM (SELECT x, abs(y - y_at) AS g, lead(x) OVER (ORDER BY x) AS x1, lead(abs(y - y_at)) OVER (ORDER BY x) AS g1 FROM curve_at) t) p,
    (SELECT {_AUC.format(w0='s0', w1='s1')} AS auc FROM (SELECT *, sum(s0) OVER (ORDER BY h) AS c0 FROM (SELECT h, sum(CASE WHEN y = 0 THEN weight ELSE 0 END) AS s0,
       sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS s1 FROM split4 WHERE split = 'train' GROUP BY h) g) c) q"""))
def overtraining(spark, d):
    rows, train, valid = _split_curves(spark, d)
    out = X.overtraining(train, valid, X.auc(rows, "h", "y"))
    return out.select(r("area", 8).alias("area"), r("percent", 5).alias("percent"))
