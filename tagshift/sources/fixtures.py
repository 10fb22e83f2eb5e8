"""Event tables derived from the given TPC-H-like tables.

The four leading lines of an order become the jets of an event; tag, region, weights and scores
follow from the key and the kinematics.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagshift.functions import fourvec as fv
from tagshift.functions import jets as J
from tagshift.functions.pairing import SELECTION, with_pairing

_LINE_ORDER = [F.desc, F.asc, F.asc, F.asc, F.asc]
_LINE_KEYS = ["l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _jet_columns() -> list:
    return [
        (30 + F.col("l_extendedprice") / 500).alias("pt"),
        ((F.col("l_discount") * 100 - 5) * 0.5).alias("eta"),
        (F.col("l_quantity") * 2 * math.pi / 50 - math.pi).alias("phi"),
        (5 + F.col("l_tax") * 100).alias("m"),
    ]


def ranked_jets(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    """The leading ``limit`` jets (or all) of every order, one row per jet.

    The rank filter lets Spark cut each order to ``limit`` rows before the shuffle.
    """
    order = [how(c) for how, c in zip(_LINE_ORDER, _LINE_KEYS)]
    w = W.partitionBy("l_orderkey").orderBy(*order)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    ranked = lines.withColumn("_rn", F.row_number().over(w))
    return (
        (ranked if limit is None else ranked.where(F.col("_rn") <= limit))
        .select(F.col("l_orderkey").alias("event_id"), (F.col("_rn") - 1).alias("jet"), *_jet_columns())
    )


def all_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a jet, unranked: one row per jet."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), *_jet_columns())


def jet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and the array of the four leading jets, for orders with at least four lines."""
    fields = ["pt", "eta", "phi", "m"]
    picked = ranked_jets(spark, sf_dir, 4).groupBy("event_id").agg(
        *[F.max(F.when(F.col("jet") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in fields]
    ).where(F.col("pt3").isNotNull())
    return picked.select(
        "event_id",
        F.array(*[
            F.struct(
                *[F.col(f"{c}{i}").alias(c) for c in fields],
                fv.energy_from_mass(F.col(f"pt{i}"), F.col(f"eta{i}"), F.col(f"m{i}")).alias("e"),
            )
            for i in range(4)
        ]).alias("jets"),
    )


def with_labels(df: DataFrame) -> DataFrame:
    """Tag, region and the two weights: fixed rules of ``event_id``."""
    key = F.col("event_id")
    weight = 0.5 + (key % 5) / 10
    return df.select(
        "*",
        F.when(key % 7 == 0, "4b").otherwise("3b").alias("tag"),
        F.when(key % 10 < 3, "SR").when(key % 10 < 7, "CR").otherwise("SB").alias("region"),
        weight.alias("weight"),
        F.when(key % 11 == 0, F.lit(-0.5)).otherwise(weight).alias("signed_weight"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled four-jet events with sT, m4j, longitudinal sum and the two scores ``h`` and ``svb``.

    ``sT`` is rounded so that equal sums are equal numbers whatever the order of summation.
    """
    return _derived(with_labels(jet_events(spark, sf_dir)))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-jet signal sample: every order again with harder and more central jets, ids below zero, small weights."""
    jets = jet_events(spark, sf_dir)
    shifted = F.transform("jets", lambda x: F.struct(
        (1.25 * x["pt"]).alias("pt"), (0.6 * x["eta"]).alias("eta"), x["phi"].alias("phi"), x["m"].alias("m"),
        fv.energy_from_mass(1.25 * x["pt"], 0.6 * x["eta"], x["m"]).alias("e")))
    rows = with_labels(jets.select("event_id", shifted.alias("jets"))).withColumn("weight", F.col("weight") / 100)
    return _derived(rows.withColumn("tag", F.lit("signal")).withColumn("event_id", -1 - F.col("event_id")))


def _derived(rows: DataFrame) -> DataFrame:
    df = J.with_vectors(rows)
    j = F.col("jets")
    df = df.select(
        "*",
        F.round(J.scalar_pt_sum(j), 5).alias("sT"),
        J.longitudinal_sum(j).alias("sum_pz"),
        J.four_jet_mass().alias("m4j"),
    ).drop(*[f"{c}{i}" for c in fv.Vec._fields for i in range(4)])
    return df.select(
        "*",
        F.round(1 / (1 + F.exp(-(F.col("sT") - 618) / 200)), 3).alias("h"),
        F.round(1 / (1 + F.exp(-(F.col("m4j") - 1200) / 400)), 3).alias("svb"),
    )


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus the close and other dijet distance, mean |eta| and the two-Higgs mass."""
    return widened(events(spark, sf_dir))


def widened(rows: DataFrame) -> DataFrame:
    """Events of any sample with the variables of the histograms."""
    df = with_pairing(J.with_dijets(rows), SELECTION)
    # rounded, so that equal distances are equal numbers and bin edges are hit or missed for certain
    df = df.select("*", *[F.round(f"dR{p}", 9).alias(f"_dr{p}") for p in J.PAIRS])
    df = df.withColumn("_near", F.least(*[f"_dr{p}" for p in J.PAIRS]))
    other = None
    for a, b in [x for a, b in J.PAIRINGS for x in ((a, b), (b, a))]:
        hit = F.col("_near") == F.col(f"_dr{a}")
        other = F.when(hit, F.col(f"_dr{b}")) if other is None else other.when(hit, F.col(f"_dr{b}"))
    return df.select(
        *events_columns(),
        F.col("_near").alias("dRjjClose"),
        other.alias("dRjjOther"),
        J.mean_abs_eta(F.col("jets")).alias("aveAbsEta"),
        F.coalesce("pair_mhh", F.lit(0.0)).alias("mHH"),
    )


def events_columns() -> list[str]:
    return ["event_id", "jets", "tag", "region", "weight", "signed_weight", "sT", "sum_pz", "m4j", "h", "svb"]


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-like sample from ``orders``: region and class from the key, weight from the price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("event_id"),
        F.when(key % 10 < 3, "SR").when(key % 10 < 7, "CR").when(key % 10 < 9, "SB").otherwise("none").alias("region"),
        F.when(key % 3 == 0, "zz").otherwise("zh").alias("signal_class"),
        (F.col("o_totalprice") / 100000).alias("weight"),
    )
