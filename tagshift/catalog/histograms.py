"""Weight sums, histograms and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, query, r, sql
from tagshift.constants import HISTOGRAM_VARIABLES, MASS_EDGES, MASS_PLANE_BINS, PI_4B_LARGE, SIGNAL_FRACTION
from tagshift.functions import jets as J
from tagshift.functions import scores as S
from tagshift.functions.pairing import MASS_PLANE, with_pairing
from tagshift.operators import hist as H
from tagshift.operators import norms as N
from tagshift.operators import split as SP
from tagshift.sources import fixtures as fx
from tagshift.sources.store import materialize


def bin_sql(x: str, binning) -> str:
    if isinstance(binning, list):
        return "(" + " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in binning) + ")"
    n, lo, hi = binning
    return f"greatest(0, least({n + 1}, floor(({x} - {lo}) * {float(n)} / {float(hi) - float(lo)}) + 1))"


_SQL_COLUMNS = {
    **{f"jetPt{i}": f"pt{i}" for i in range(4)}, **{f"jetEnergy{i}": f"e{i}" for i in range(4)},
    "sT": "pt0 + pt1 + pt2 + pt3", "SvB": "svb", "FvT": "h",
}


def _cells(view: str, where: str = "true", keys: str = "region", weight: str = "weight") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS variable, {bin_sql('(' + _SQL_COLUMNS.get(name, name) + ')', b)} AS bin, {weight} AS w FROM {view} WHERE {where}"
        for name, (_, b) in HISTOGRAM_VARIABLES.items()
    )


def _hist(view: str, body: str, keys: str = "region") -> str:
    return sql(view, f"""SELECT {keys}, variable, {B('bin')} AS bin, {B('count(*)')} AS entries, {R('sum(w)', 4)} AS sumw,
        {R('sum(w * w)', 4)} AS sumw2 FROM ({body}) c GROUP BY {keys}, variable, bin""")


def tidy(h, keys=("region",)):
    return h.select(
        *keys, "variable", big("bin").alias("bin"), big("entries").alias("entries"), r("sumw", 4).alias("sumw"), r("sumw2", 4).alias("sumw2")
    )


@query("d01_transfer_norms", sql("norms", f"SELECT {R('w3b_CR', 4)} AS w3b_CR, {R('w3b_SR', 4)} AS w3b_SR, {R('w4b_CR', 4)} AS w4b_CR, {R('pi', 8)} AS pi FROM norms"))
def transfer_norms(spark, d):
    n = N.transfer_norms(fx.events(spark, d))
    return n.select(*[r(c, 4).alias(c) for c in ("w3b_CR", "w3b_SR", "w4b_CR")], r("pi", 8).alias("pi"))


@query("d02_counts_rollup", sql("events4", f"SELECT tag, region, {B('count(*)')} AS n, {R('sum(weight)', 4)} AS sumw FROM events4 GROUP BY ROLLUP (tag, region)"))
def counts_rollup(spark, d):
    return N.totals_rollup(fx.events(spark, d)).select("tag", "region", big("n").alias("n"), r("sumw", 4).alias("sumw"))


@query("d03_uniform_histogram", _hist("events4", f"SELECT region, 'sT' AS variable, {bin_sql('sT', (40, 150, 550))} AS bin, weight * {PI_4B_LARGE} AS w FROM events4 WHERE tag = '4b' AND region = 'SR'"))
def uniform_histogram(spark, d):
    e = fx.events(spark, d).where("tag = '4b' AND region = 'SR'")
    return tidy(H.fill(e, {"sT": HISTOGRAM_VARIABLES["sT"]}, ["region"], scale=PI_4B_LARGE))


@query("d04_variable_edges_histogram", _hist("events4", f"SELECT region, 'm4j' AS variable, {bin_sql('m4j', MASS_EDGES)} AS bin, weight AS w FROM events4"))
def variable_edges_histogram(spark, d):
    return tidy(H.fill(fx.events(spark, d), {"m4j": HISTOGRAM_VARIABLES["m4j"]}, ["region"]))


@query("d05_all_histograms", _hist("wide", _cells("wide", "tag = '4b' AND region IN ('CR', 'SR')")))
def all_histograms(spark, d):
    e = fx.wide_events(spark, d).where("tag = '4b' AND region IN ('CR', 'SR')")
    return tidy(H.fill(e, HISTOGRAM_VARIABLES, ["region"]))


@query("d06_histogram_errors", sql("", f"""SELECT event_type, {B('bin')} AS bin, {R('n / sum(n) OVER (PARTITION BY event_type)', 8)} AS n,
      {R('e / sum(n) OVER (PARTITION BY event_type)', 8)} AS error
    FROM (SELECT event_type, CASE WHEN value = 200 THEN 40 ELSE least(41, greatest(0, floor(value * 40 / 200) + 1)) END AS bin, sum(w) AS n, sqrt(sum(w * w)) AS e
          FROM (SELECT event_type, value, 1 + user_id % 3 AS w FROM events) x GROUP BY 1, 2) t"""))
def histogram_errors(spark, d):
    """Closed last bin; rows outside the edges are bins 0 and 41."""
    e = fx.table(spark, d, "events").select("event_type", "value", (1 + F.col("user_id") % 3).cast("double").alias("w"))
    h = H.fill(e, {"value": ("value", (40, 0.0, 200.0))}, ["event_type"], weight="w", closed_last=True)
    return H.errors(h, norm=1.0, keys=["event_type"]).select("event_type", big("bin").alias("bin"), r("n", 8).alias("n"), r("error", 8).alias("error"))


_FIT = f"""SELECT region, bin, sumw / sum(sumw) OVER (PARTITION BY region) AS share FROM
    (SELECT region, {bin_sql('m4j', MASS_EDGES)} AS bin, sum(weight) AS sumw FROM events4 WHERE m4j >= 200 AND m4j < 1000 GROUP BY 1, 2) t"""
_EDGES = "(VALUES " + ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(zip(MASS_EDGES, MASS_EDGES[1:]))) + ") e(bin, lo, hi)"


@query("d07_unit_area", sql("events4", f"""SELECT region, {B('t.bin')} AS bin, {R('share', 8)} AS share, {R('share / (hi - lo)', 8)} AS density
    FROM ({_FIT}) t JOIN {_EDGES} ON t.bin = e.bin"""))
def unit_area(spark, d):
    v = {"m4j": HISTOGRAM_VARIABLES["m4j"]}
    h = H.unit_area(H.with_edges(H.fill(fx.events(spark, d), v, ["region"]), v), ["region"])
    return h.select("region", big("bin").alias("bin"), r("share", 8).alias("share"), r("density", 8).alias("density"))


def _ratio_sql(num: str, den: str, view: str) -> str:
    return sql(view, f"""SELECT region, {B('bin')} AS bin, {R('num', 4)} AS num, {R('den', 4)} AS den,
        {R('CASE WHEN den <> 0 THEN num / den ELSE 0 END', 6)} AS ratio,
        {R('CASE WHEN den <> 0 THEN sqrt((dn / den) ** 2 + (dd * num / (den * den)) ** 2) ELSE 0 END', 6)} AS ratio_err
      FROM (SELECT region, bin, sum(CASE WHEN {num} THEN w ELSE 0 END) AS num, sum(CASE WHEN {den} THEN w ELSE 0 END) AS den,
              sqrt(sum(CASE WHEN {num} THEN w * w ELSE 0 END)) AS dn, sqrt(sum(CASE WHEN {den} THEN w * w ELSE 0 END)) AS dd
            FROM (SELECT region, tag, weight AS w, {bin_sql('sT', (40, 150, 550))} AS bin FROM events4 WHERE region IN ('CR', 'SR')) c GROUP BY 1, 2) t""")


def _ratio(spark, d):
    e = fx.events(spark, d).where("region IN ('CR', 'SR')")
    v = {"sT": ("sT", (40, 150.0, 550.0))}
    h = materialize(H.fill(e, v, ["region", "tag"]), "hist")
    pick = lambda t: h.where(F.col("tag") == t).drop("tag")
    c = H.compare(pick("4b"), pick("3b"), ["region"])
    return c.select("region", big("bin").alias("bin"), *[r(x, 4).alias(x) for x in ("num", "den")], r("ratio").alias("ratio"), r("ratio_err").alias("ratio_err"))


query("d08_bin_ratio", _ratio_sql("tag = '4b'", "tag = '3b'", "events4"))(_ratio)


@query("f06_histogram_join", sql("events4", f"""SELECT region, {B('bin')} AS bin, {R("sum(CASE WHEN tag = '4b' THEN weight ELSE 0 END)", 4)} AS h4b,
      {R("sum(CASE WHEN tag = '3b' THEN weight ELSE 0 END)", 4)} AS h3b FROM
      (SELECT *, {bin_sql('m4j', MASS_EDGES)} AS bin FROM events4) c GROUP BY region, bin"""))
def histogram_join(spark, d):
    h = materialize(H.fill(fx.events(spark, d), {"m4j": HISTOGRAM_VARIABLES["m4j"]}, ["region", "tag"]), "hist")
    pick = lambda t, n: h.where(F.col("tag") == t).select("region", "bin", F.col("sumw").alias(n))
    return pick("4b", "h4b").join(pick("3b", "h3b"), ["region", "bin"], "full").select(
        "region", big("bin").alias("bin"), *[r(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("h4b", "h3b")]
    )


_PLANE = (MASS_PLANE_BINS[0], MASS_PLANE_BINS[1], MASS_PLANE_BINS[2])


@query("d09_mass_plane", sql("pair_plane", f"""SELECT region, {B('x')} AS x_bin, {B('y')} AS y_bin, {B('count(*)')} AS entries FROM
    (SELECT e.region, {bin_sql('p.lead_m', _PLANE)} AS x, {bin_sql('p.subl_m', _PLANE)} AS y FROM pair_plane p JOIN events4 e ON p.event_id = e.event_id) t GROUP BY 1, 2, 3"""))
def mass_plane(spark, d):
    p = with_pairing(J.with_dijets(fx.events(spark, d)), MASS_PLANE).where(F.col("pairing").isNotNull())
    h = H.fill_2d(p, F.col("lead_m"), F.col("subl_m"), MASS_PLANE_BINS, MASS_PLANE_BINS, ["region"])
    return h.select("region", *[big(c).alias(c) for c in ("x_bin", "y_bin", "entries")])


@query("d10_weight_plane", sql("events4", f"""SELECT {B('x')} AS x_bin, {B('y')} AS y_bin, {B('count(*)')} AS entries FROM
    (SELECT CASE WHEN h = h1 THEN 30 ELSE floor((h - h0) * 30 / (h1 - h0)) + 1 END AS x,
            CASE WHEN svb = s1 THEN 30 ELSE floor((svb - s0) * 30 / (s1 - s0)) + 1 END AS y
     FROM (SELECT h, svb, min(h) OVER () AS h0, max(h) OVER () AS h1, min(svb) OVER () AS s0, max(svb) OVER () AS s1
           FROM events4 WHERE region = 'SR' AND tag = '3b') a) b GROUP BY 1, 2"""))
def weight_plane(spark, d):
    """30 x 30 bins over the observed range of two score columns, upper edge included."""
    e = materialize(fx.events(spark, d).where("region = 'SR' AND tag = '3b'").select("h", "svb"), "scores")
    ends = e.agg(*[f(c).alias(f"{n}_{c}") for c in ("h", "svb") for n, f in (("lo", F.min), ("hi", F.max))])

    def index(c):
        lo, hi = N.scalar(ends, f"lo_{c}"), N.scalar(ends, f"hi_{c}")
        return F.when(F.col(c) == hi, 30).otherwise(F.floor((F.col(c) - lo) * 30 / (hi - lo)) + 1)

    return e.select(big(index("h")).alias("x_bin"), big(index("svb")).alias("y_bin")).groupBy("x_bin", "y_bin").agg(
        big(F.count(F.lit(1))).alias("entries")
    )


@query("d11_univariate_by_tag", _hist("wide", _cells("wide", "true", "tag, region", "1.0"), "tag, region"))
def univariate_by_tag(spark, d):
    e = fx.wide_events(spark, d)
    return tidy(H.fill(e, HISTOGRAM_VARIABLES, ["tag", "region"], weight=F.lit(1.0)), ("tag", "region"))


@query("d12_class_probabilities", sql("events4", f"""SELECT split, true_class, prob_class, {B('bin')} AS bin, {R('sum(w) / max(tot)', 8)} AS share FROM
    (SELECT s.split, s.true_class, c.prob_class, s.w, s.tot, least(26, greatest(0, floor((CASE WHEN c.prob_class = 'd4' THEN h ELSE 1 - h END + 5 / 21) * 21) + 1)) AS bin
     FROM (SELECT *, sum(w) OVER (PARTITION BY split) AS tot FROM
             (SELECT h, weight AS w, CASE WHEN tag = '4b' THEN 'd4' ELSE 'd3' END AS true_class,
                CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 3 < 2 THEN 'train' ELSE 'valid' END AS split FROM events4 WHERE region = 'CR') x) s,
          (VALUES ('d4'), ('d3')) c(prob_class)) t GROUP BY 1, 2, 3, 4"""))
def class_probabilities(spark, d):
    """Probability of each class by true class, in 1/21 wide bins from -5/21 to 20/21; bins 0 and 26 are what lies outside."""
    e = fx.events(spark, d).where("region = 'CR'").select("event_id", "tag", "weight", "h")
    s = SP.modular_split(e).withColumn("true_class", F.when(F.col("tag") == "4b", "d4").otherwise("d3"))
    total = s.groupBy("split").agg(F.sum("weight").alias("total"))
    binned = s.select(
        "split", "true_class", "weight",
        F.explode(F.array(
            F.struct(F.lit("d4").alias("prob_class"), F.col("h").alias("p")), F.struct(F.lit("d3").alias("prob_class"), (1 - F.col("h")).alias("p"))
        )).alias("c"),
    ).select("split", "true_class", "weight", "c.prob_class", F.least(F.lit(26), F.greatest(F.lit(0), F.floor((F.col("c.p") + 5 / 21) * 21) + 1)).alias("bin"))
    h = binned.groupBy("split", "true_class", "prob_class", "bin").agg(F.sum("weight").alias("w"))
    return h.join(total, "split").select("split", "true_class", "prob_class", big("bin").alias("bin"), r(F.col("w") / F.col("total"), 8).alias("share"))


@query("d12_ratio_by_class", sql("events4", f"""SELECT split, sample, {B('bin')} AS bin, {R('sum(w / tot)', 8)} AS share FROM
    (SELECT split, sample, least(71, greatest(0, floor((ratio + 0.5) * 20) + 1)) AS bin, CASE WHEN sample = 'model' THEN w * ratio ELSE w END AS w, tot FROM
      (SELECT split, CASE WHEN tag = '4b' THEN 'd4' ELSE 'model' END AS sample, round(h / (1 - h), 9) AS ratio, weight AS w, sum(weight) OVER (PARTITION BY split) AS tot FROM
        (SELECT *, CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 3 < 2 THEN 'train' ELSE 'valid' END AS split FROM events4 WHERE region = 'CR') x) y) z
    GROUP BY 1, 2, 3"""))
def ratio_by_class(spark, d):
    """Class ratio of 4b events and of the reweighted 3b model, in 0.05 wide bins from -0.5 to 3, with what lies outside in bins 0 and 71."""
    e = fx.events(spark, d).where("region = 'CR'").select("event_id", "tag", "weight", "h")
    s = materialize(SP.modular_split(e), "split").withColumn("ratio", F.round(S.class_ratio(F.col("h"), 1 - F.col("h")), 9))
    total = s.groupBy("split").agg(F.sum("weight").alias("total"))
    s = s.withColumn("sample", F.when(F.col("tag") == "4b", "d4").otherwise("model")).withColumn(
        "w", F.when(F.col("tag") == "4b", F.col("weight")).otherwise(F.col("weight") * F.col("ratio"))
    )
    h = H.fill(s, {"ratio": ("floor((ratio + 0.5D) * 20D)", (70, 0.0, 70.0))}, ["split", "sample"], weight="w")
    return h.join(total, "split").select("split", "sample", big("bin").alias("bin"), r(F.col("sumw") / F.col("total"), 8).alias("share"))


@query("i07_training_weights", sql("events4", f"""SELECT tag, {B('count(*)')} AS n, {R('sum(tw)', 4)} AS sumw, {R('max(tw)', 6)} AS largest FROM
    (SELECT tag, CASE WHEN tag = '4b' THEN 1.0 ELSE weight * n4 / w3 END AS tw FROM
      (SELECT *, count(*) FILTER (WHERE tag = '4b') OVER () AS n4, sum(weight) FILTER (WHERE tag = '3b') OVER () AS w3 FROM events4 WHERE region = 'CR') a) b GROUP BY tag"""))
def training_weights(spark, d):
    t = N.training_weights(materialize(fx.events(spark, d).select("event_id", "tag", "region", "weight"), "labels"))
    return t.groupBy("tag").agg(big(F.count(F.lit(1))).alias("n"), r(F.sum("train_weight"), 4).alias("sumw"), r(F.max("train_weight")).alias("largest"))


@query("i08_signal_to_background", sql("signal events4", f"""SELECT {B('event_id')} AS event_id,
    {R('weight * (SELECT sum(weight) FROM events4) / (SELECT sum(weight) FROM signal)', 6)} AS scaled FROM signal"""))
def signal_to_background(spark, d):
    out = N.signal_to_background(fx.signal(spark, d), fx.events(spark, d).select("weight"))
    return out.select("event_id", r("scaled").alias("scaled"))


@query("i09_signal_classes_to_background", sql("signal events4", f"""SELECT {B('event_id')} AS event_id, signal_class,
    {R('weight * (SELECT sum(weight) FROM events4) / sum(weight) OVER (PARTITION BY signal_class)', 6)} AS scaled FROM signal"""))
def signal_classes_to_background(spark, d):
    out = N.signal_to_background(fx.signal(spark, d), fx.events(spark, d).select("weight"), by_class="signal_class")
    return out.select("event_id", "signal_class", r("scaled").alias("scaled"))


_FRACTIONS = "CASE s.region " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in SIGNAL_FRACTION.items()) + " END"


@query("i10_signal_by_region", sql("signal events4", f"""SELECT {B('s.event_id')} AS event_id, s.region, {R(f'coalesce(s.weight * f.w * {_FRACTIONS} / o.w, s.weight)', 8)} AS scaled
    FROM signal s LEFT JOIN (SELECT region, sum(weight) AS w FROM events4 WHERE tag = '4b' GROUP BY 1) f ON s.region = f.region
    LEFT JOIN (SELECT region, sum(weight) AS w FROM signal GROUP BY 1) o ON s.region = o.region"""))
def signal_by_region(spark, d):
    four = fx.events(spark, d).where("tag = '4b'").select("region", "weight")
    return N.signal_to_four_tag(fx.signal(spark, d), four).select("event_id", "region", r("scaled", 8).alias("scaled"))


@query("i11_global_rescale", sql("signal", f"SELECT {B('event_id')} AS event_id, {R('weight * 7134 / count(*) OVER ()', 12)} AS scaled FROM signal"))
def global_rescale(spark, d):
    return N.global_rescale(fx.signal(spark, d), 7134).select("event_id", r("scaled", 12).alias("scaled"))


@query("i12_combined_weight", sql("events4", f"SELECT {B('event_id')} AS event_id, {R('weight * h', 6)} AS combined FROM events4"))
def combined_weight(spark, d):
    return fx.events(spark, d).select("event_id", r(F.col("weight") * F.col("h")).alias("combined"))

