"""Conversion and histograms that follow deliveries of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, define, query, r, sql
from tagshift.catalog.histograms import _cells, _hist, tidy
from tagshift.constants import HISTOGRAM_VARIABLES, MIN_JET_PT
from tagshift.functions import fourvec as fv
from tagshift.functions import jets as J
from tagshift.functions.pairing import SELECTION, with_pairing
from tagshift.operators import hist as H
from tagshift.sources import fixtures as fx
from tagshift.sources import tables as T
from tagshift.sources.store import materialize, materialize_wide, new_path
from tagshift.streaming.conversion import convert_new_files, converted, update_catalogue

DELIVERIES = 3


def raw_events(spark, d):
    """Events as they arrive: all jets of an order, up to 16, the hardest first."""
    # at most 16 rows of an event reach the collection
    jets = fx.ranked_jets(spark, d, 16).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("jet", "pt", "eta", "phi", "m"))).alias("all"))
    return jets.where(F.size("all") >= 4)


def prepared(raw):
    """Events with at least four jets over threshold and a valid pairing of the leading ones, with their masses."""
    raw = raw.where(J.count_selected(F.col("all"), MIN_JET_PT, 2.5) >= 4)
    lead = F.transform(F.slice("all", 1, 4), lambda j: F.struct(j["pt"].alias("pt"), j["eta"].alias("eta"), j["phi"].alias("phi"), j["m"].alias("m"), fv.energy_from_mass(j["pt"], j["eta"], j["m"]).alias("e")))
    rows = J.with_vectors(fx.with_labels(raw.select("event_id", "all", lead.alias("jets"))))
    rows = rows.select("event_id", "all", "jets", "tag", "region", "weight", J.four_jet_mass().alias("m4j"), J.scalar_pt_sum(F.col("jets")).alias("sT"))
    paired = with_pairing(J.with_dijets(rows), SELECTION).where("pairing IS NOT NULL AND pair_mhh > 0")
    return paired.select("event_id", "tag", "region", "weight", "m4j", "sT", F.col("pair_mhh").alias("mHH"), J.padded_other_jets(F.slice("all", 5, 12)).alias("others"))


OUTPUTS = {
    "features": lambda rows: rows.drop("others"),
    "other_jets": lambda rows: rows.select("event_id", F.posexplode("others").alias("slot", "j")).select("event_id", "slot", "j.*"),
    "counts": lambda rows: rows.groupBy("region", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sumw")),
}
define("picked", ["wide", "jets_ranked"], """SELECT w.event_id, w.region, w.tag, w.weight, w.sT, w.m4j, w.mHH FROM wide w JOIN
    (SELECT event_id FROM jets_ranked WHERE jet < 16 GROUP BY event_id HAVING count(*) FILTER (WHERE pt > 40 AND abs(eta) < 2.5) >= 4) s ON s.event_id = w.event_id WHERE w.mHH > 0""")


@query("a05_conversion_stream", sql("picked", f"""SELECT 'features' AS output, region AS part, {B('count(*)')} AS n, {R('sum(mHH + m4j)', 2)} AS total FROM picked GROUP BY region
    UNION ALL SELECT 'counts', region || tag, {B('count(*)')}, {R('sum(weight)', 2)} FROM picked GROUP BY region, tag
    UNION ALL SELECT 'other_jets', CAST(s.slot AS VARCHAR), {B('count(*) FILTER (WHERE j.pt > 40 AND abs(j.eta) < 2.4)')}, {R('sum(coalesce(j.pt, 0))', 2)}
      FROM picked p CROSS JOIN (SELECT range AS slot FROM range(12)) s LEFT JOIN jets_ranked j ON j.event_id = p.event_id AND j.jet = s.slot + 4 GROUP BY s.slot"""))
def conversion_stream(spark, d):
    """Raw jets in three deliveries become features, padded jets and counts per region."""
    root = new_path(spark, "conversion")
    raw = materialize(raw_events(spark, d), "raw")
    for k in range(DELIVERIES):
        T.append(raw.where(F.col("event_id") % DELIVERIES == k), f"{root}/raw")
        convert_new_files(spark, f"{root}/raw", f"{root}/out", f"{root}/progress", prepared, OUTPUTS)
    out = {name: converted(spark, f"{root}/out", name) for name in OUTPUTS}
    part = lambda name, key, n, total: out[name].groupBy(key.alias("part")).agg(big(n).alias("n"), r(total, 2).alias("total")).select(F.lit(name).alias("output"), "*")
    return part("features", F.col("region"), F.count(F.lit(1)), F.sum(F.col("mHH") + F.col("m4j"))).unionByName(
        part("counts", F.concat("region", "tag"), F.sum("n"), F.sum("sumw"))).unionByName(
        part("other_jets", F.col("slot").cast("string"), F.count_if(F.col("isSelJet") == 1), F.sum("pt")))


def count_bins(events):
    return H.fill(events.where("tag = '4b' AND region IN ('CR', 'SR')").withColumn("sample", F.lit("h4b")), HISTOGRAM_VARIABLES, ["region", "sample"])


def deliver_histograms(spark, root, events, replace=T.write_catalogue):
    """Appends ``events`` to the delivered ones and brings the catalogue up to date."""
    T.append(events, f"{root}/raw")
    update_catalogue(spark, f"{root}/raw", f"{root}/catalogue", f"{root}/progress", f"{root}/log", count_bins, ["region", "sample"], ["variable", "bin"], replace)


@query("a11_incremental_histograms", _hist("wide", _cells("wide", "tag = '4b' AND region IN ('CR', 'SR')")))
def incremental_histograms(spark, d):
    """The catalogue after three deliveries holds the histograms of all events."""
    root = new_path(spark, "histograms")
    wide = materialize_wide(fx.wide_events(spark, d), "wide")
    for k in range(DELIVERIES):
        deliver_histograms(spark, root, wide.where(F.col("event_id") % DELIVERIES == k))
    return tidy(spark.read.parquet(f"{root}/catalogue").drop("sample"))
