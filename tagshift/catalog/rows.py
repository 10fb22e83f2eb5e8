"""Row filters, samples, splits, labels and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagshift.catalog.base import B, R, big, query, r, sql
from tagshift.functions import jets as J
from tagshift.functions import scores as S
from tagshift.functions.pairing import MASS_PLANE, with_pairing
from tagshift.operators import split as SP
from tagshift.sources import fixtures as fx


@query("b01_region_filter", sql("events4", f"SELECT {B('event_id')} AS event_id, {R('m4j', 4)} AS m4j FROM events4 WHERE region = 'CR'"))
def region_filter(spark, d):
    return fx.events(spark, d).where(F.col("region") == "CR").select("event_id", r("m4j", 4).alias("m4j"))


@query("b02_region_union_filter", sql("events4", f"""SELECT {B('event_id')} AS event_id, region, {R('weight', 4)} AS weight
    FROM events4 WHERE region IN ('CR', 'SR')"""))
def region_union_filter(spark, d):
    return fx.events(spark, d).where(F.col("region").isin("CR", "SR")).select("event_id", "region", r("weight", 4).alias("weight"))


@query("b03_tag_filter", sql("events4", f"SELECT {B('event_id')} AS event_id, region, {R('sT', 4)} AS sT FROM events4 WHERE tag <> '4b'"))
def tag_filter(spark, d):
    return fx.events(spark, d).where(F.col("tag") != "4b").select("event_id", "region", r("sT", 4).alias("sT"))


@query("b04_jet_selection_counts", sql("jets_ranked", f"""SELECT {B('jet_max')} AS jet_max, {B('count(*)')} AS n_events, {B('sum(n_jets)')} AS n_jets
    FROM (SELECT event_id, count(*) FILTER (WHERE pt > 40 AND abs(eta) < 2.5) AS n_jets FROM jets_ranked GROUP BY event_id) e,
         (VALUES (4), (5), (100)) v(jet_max)
    WHERE n_jets >= 4 AND n_jets <= jet_max GROUP BY jet_max"""))
def jet_selection_counts(spark, d):
    passed = (F.col("pt") > 40) & (F.abs("eta") < 2.5)
    per_event = fx.all_jets(spark, d).groupBy("event_id").agg(F.count_if(passed).alias("n_jets"))
    limits = per_event.select("n_jets", F.explode(F.array(F.lit(4), F.lit(5), F.lit(100))).alias("jet_max"))
    kept = limits.where((F.col("n_jets") >= 4) & (F.col("n_jets") <= F.col("jet_max")))
    return kept.groupBy(big("jet_max").alias("jet_max")).agg(
        big(F.count(F.lit(1))).alias("n_events"), big(F.sum("n_jets")).alias("n_jets")
    )


@query("b05_preselection", sql("events4", f"""SELECT {B('event_id')} AS event_id, region, {R('h', 3)} AS h FROM events4
    WHERE sT > 450 AND tag = '4b' AND region IN ('SB', 'CR', 'SR') AND h > 0.2"""))
def preselection(spark, d):
    e = fx.events(spark, d).withColumn("trigger", F.col("sT") > 450)
    return e.where(
        F.col("trigger") & (F.col("tag") == "4b") & F.col("region").isin("SB", "CR", "SR") & (F.col("h") > 0.2)
    ).select("event_id", "region", r("h", 3).alias("h"))


@query("b06_valid_pairing_only", sql("wide", f"SELECT {B('event_id')} AS event_id, {R('mHH', 3)} AS mHH FROM wide WHERE mHH > 0"))
def valid_pairing_only(spark, d):
    return fx.wide_events(spark, d).where(F.col("mHH") > 0).select("event_id", r("mHH", 3).alias("mHH"))


@query("b07_first_n", sql("events4", f"SELECT {B('event_id')} AS event_id, {R('sT', 4)} AS sT FROM events4 ORDER BY event_id LIMIT 1000"))
def first_n(spark, d):
    return SP.first_n(fx.events(spark, d).select("event_id", r("sT", 4).alias("sT")), 1000)


_HASH = "md5(concat_ws('|', {x}, 5))"


@query("b08_random_subset", sql("events4", f"""SELECT {B('event_id')} AS event_id FROM events4
    ORDER BY {_HASH.format(x='event_id')}, event_id LIMIT 1000"""))
def random_subset(spark, d):
    return SP.random_n(fx.events(spark, d).select("event_id"), 1000, seed=5)


@query("b08_random_draws_with_replacement", sql("events4", f"""SELECT {B('draw')} AS draw, {B('event_id')} AS event_id FROM
    (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events4) e
    JOIN (SELECT range AS draw, CAST('0x' || substr({_HASH.format(x='range')}, 1, 15) AS BIGINT) AS u FROM range(3000)) x
      ON x.u % e.n = e.k"""))
def random_draws(spark, d):
    return SP.draw_with_replacement(fx.events(spark, d).select("event_id"), 3000, seed=5).select("draw", "event_id")


@query("b09_class_label", sql("events4", """SELECT CAST(event_id AS BIGINT) AS event_id,
    CAST(CASE WHEN tag = '4b' THEN 1 ELSE 0 END AS BIGINT) AS label FROM events4"""))
def class_label(spark, d):
    return fx.events(spark, d).select("event_id", big(F.when(F.col("tag") == "4b", 1).otherwise(0)).alias("label"))


@query("b10_one_hot", sql("events4", f"""SELECT tag, region, {B("sum(CASE WHEN tag = '4b' THEN 1 ELSE 0 END)")} AS is_1,
    {B("sum(CASE WHEN tag = '3b' THEN 1 ELSE 0 END)")} AS is_0 FROM events4 GROUP BY tag, region"""))
def one_hot(spark, d):
    zero, one = S.one_hot(F.when(F.col("tag") == "4b", 1).otherwise(0), 2)
    return fx.events(spark, d).select("tag", "region", zero.alias("z"), one.alias("o")).groupBy("tag", "region").agg(
        big(F.sum("o")).alias("is_1"), big(F.sum("z")).alias("is_0")
    )


@query("b11_mass_window", sql("pair_plane", f"""SELECT {B('event_id')} AS event_id, {R('lead_m', 3)} AS lead_m, {R('subl_m', 3)} AS subl_m
    FROM pair_plane WHERE lead_m BETWEEN 90 AND 400 AND subl_m BETWEEN 60 AND 400"""))
def mass_window(spark, d):
    p = with_pairing(J.with_dijets(fx.events(spark, d)), MASS_PLANE)
    return p.where(F.col("lead_m").between(90, 400) & F.col("subl_m").between(60, 400)).select(
        "event_id", r("lead_m", 3).alias("lead_m"), r("subl_m", 3).alias("subl_m")
    )


@query("b13_flat_jets", sql("vec", "SELECT " + B("event_id") + " AS event_id, " + ", ".join(
    f"{R(f'{c}{i}', 4)} AS canJet{i}_{c}" for i in range(4) for c in ("pt", "eta", "phi", "e", "m")) + " FROM vec"))
def flat_jets(spark, d):
    flat = J.flatten_jets(fx.jet_events(spark, d)).drop("jets")
    return flat.select("event_id", *[r(c, 4).alias(c) for c in flat.columns if c != "event_id"])


@query("b14_padded_other_jets", sql("jets_ranked", f"""SELECT {B('slot')} AS slot, {B('sel')} AS isSelJet, {B('count(*)')} AS n, {R('sum(pt)', 3)} AS sum_pt,
      {R('sum(abs(eta))', 3)} AS sum_abs_eta
    FROM (SELECT e.event_id, s.slot, coalesce(j.pt, 0) AS pt, coalesce(j.eta, 0) AS eta,
            CASE WHEN j.pt IS NULL THEN -1 WHEN j.pt > 40 AND abs(j.eta) < 2.4 THEN 1 ELSE 0 END AS sel
          FROM (SELECT DISTINCT event_id FROM jets_ranked WHERE n >= 4) e CROSS JOIN (SELECT range AS slot FROM range(12)) s
          LEFT JOIN jets_ranked j ON j.event_id = e.event_id AND j.jet = s.slot + 4) t
    GROUP BY slot, sel"""))
def padded_other_jets(spark, d):
    # at most 16 rows per event reach the collection
    jets = fx.ranked_jets(spark, d, 16).groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("jet", "pt", "eta", "phi", "m"))).alias("all")
    ).where(F.size("all") >= 4)
    slots = jets.select(F.posexplode(J.padded_other_jets(F.slice("all", 5, 12))).alias("slot", "j"))
    return slots.groupBy(big("slot").alias("slot"), big("j.isSelJet").alias("isSelJet")).agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("j.pt"), 3).alias("sum_pt"), r(F.sum(F.abs("j.eta")), 3).alias("sum_abs_eta")
    )


@query("b15_forward_veto", sql("jets_ranked", f"""SELECT {B('count(*)')} AS n_jets,
    {B('count(*) FILTER (WHERE abs(eta) > 2.4 AND pt < 40)')} AS n_violations FROM jets_ranked WHERE n >= 4 AND jet >= 4"""))
def forward_veto(spark, d):
    jets = fx.ranked_jets(spark, d, None).where(F.col("jet") >= 4)
    return jets.agg(
        big(F.count(F.lit(1))).alias("n_jets"),
        big(F.count_if(J.violates_forward_veto(F.struct("pt", "eta")))).alias("n_violations"),
    )


@query("b16_expression_variables", sql("events4", f"""SELECT {B('event_id')} AS event_id, {R('pt0 + pt1 + pt2 + pt3', 4)} AS sT,
    {R('e0 + e1', 4)} AS e01 FROM events4"""))
def expression_variables(spark, d):
    exprs = {"sT": "jets[0].pt + jets[1].pt + jets[2].pt + jets[3].pt", "e01": "jets[0].e + jets[1].e"}
    return fx.events(spark, d).select("event_id", *[r(F.expr(x), 4).alias(n) for n, x in exprs.items()])


@query("e08_modular_split", sql("events4", f"""SELECT {B('event_id')} AS event_id,
    CASE WHEN (row_number() OVER (ORDER BY event_id) - 1 + 1) % 3 < 2 THEN 'train' ELSE 'valid' END AS split FROM events4"""))
def modular_split(spark, d):
    return SP.modular_split(fx.events(spark, d).select("event_id"), offset=1)


@query("e09_shuffled_split", sql("events4", f"""SELECT {B('event_id')} AS event_id, tag, CASE WHEN k <= floor(n * 0.7) THEN 'train' ELSE 'valid' END AS split
    FROM (SELECT event_id, tag, count(*) OVER (PARTITION BY tag) AS n,
            row_number() OVER (PARTITION BY tag ORDER BY md5(concat_ws('|', event_id, 3)), event_id) AS k FROM events4) t"""))
def shuffled_split(spark, d):
    return SP.shuffled_split(fx.events(spark, d).select("event_id", "tag"), "tag", 0.7, seed=3).select("event_id", "tag", "split")


@query("g01_union_by_name", sql("events4 signal", f"""SELECT sample, region, {B('count(*)')} AS n, {R('sum(weight)', 4)} AS sumw,
      {B('count(h)')} AS with_score, {B('count(signal_class)')} AS with_class
    FROM (SELECT 'background' AS sample, region, weight, h, NULL AS signal_class FROM events4
          UNION ALL SELECT 'signal', region, weight, NULL, signal_class FROM signal) u GROUP BY sample, region"""))
def union_by_name(spark, d):
    b = fx.events(spark, d).select("event_id", "region", "weight", "h").withColumn("sample", F.lit("background"))
    s = fx.signal(spark, d).withColumn("sample", F.lit("signal"))
    return b.unionByName(s, allowMissingColumns=True).groupBy("sample", "region").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("weight"), 4).alias("sumw"),
        big(F.count("h")).alias("with_score"), big(F.count("signal_class")).alias("with_class"),
    )


@query("g02_era_concat", sql("", f"""SELECT era, {B('count(*)')} AS n, {R('sum(o_totalprice)', 3)} AS total
    FROM (SELECT 'B' AS era, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL
          SELECT 'C', o_totalprice FROM orders WHERE o_orderstatus <> 'F') u GROUP BY era"""))
def era_concat(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    eras = {"B": o.where("o_orderstatus = 'F'"), "C": o.where("o_orderstatus <> 'F'")}
    parts = [x.withColumn("era", F.lit(n)) for n, x in eras.items()]
    return parts[0].unionByName(parts[1]).groupBy("era").agg(
        big(F.count(F.lit(1))).alias("n"), r(F.sum("o_totalprice"), 3).alias("total")
    )


@query("g03_long_stacking", sql("events4", f"""SELECT {B('event_id')} AS event_id, label, {R('w', 5)} AS w
    FROM (SELECT event_id, 'h' AS label, h AS w FROM events4 UNION ALL SELECT event_id, 'svb', svb FROM events4
          UNION ALL SELECT event_id, 'difference', svb - h FROM events4) u"""))
def long_stacking(spark, d):
    e = fx.events(spark, d).select("event_id", "h", "svb", (F.col("svb") - F.col("h")).alias("difference"))
    return e.unpivot("event_id", ["h", "svb", "difference"], "label", "w").select("event_id", "label", r("w", 5).alias("w"))
