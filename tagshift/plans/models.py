"""Background models: each returns (event_id, region, weight, model_weight) for 3b events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagshift.constants import BLOCK_TARGETS, HALF_STEPS
from tagshift.functions.scores import odds
from tagshift.operators.blocks import round_robin_blocks
from tagshift.operators.neighbours import knn_by_gap, neighbour_weights
from tagshift.operators.norms import scalar, transfer_norms
from tagshift.operators.transport import given_source, monotone_coupling, push
from tagshift.sources.store import materialize


def three_tag(events: DataFrame) -> DataFrame:
    return events.where(F.col("tag") == "3b")


def benchmark(events: DataFrame) -> DataFrame:
    """Constant factor w4b_CR / w3b_CR in all regions."""
    pi = scalar(transfer_norms(events), "pi")
    return three_tag(events).select("event_id", "region", "weight", (F.col("weight") * pi).alias("model_weight"))


def classifier_odds(
    events: DataFrame, scores: DataFrame, score: str = "score", regions: tuple[str, ...] = ("CR", "SR")
) -> DataFrame:
    """Odds of the 4b class times the transfer factor; other regions are dropped."""
    pi = scalar(transfer_norms(events), "pi")
    rows = three_tag(events).where(F.col("region").isin(*regions)).select("event_id", "region", "weight")
    joined = rows.join(scores.select("event_id", F.col(score).alias("_h")), "event_id")
    return joined.select(
        "event_id", "region", "weight", (F.col("weight") * odds(F.col("_h")) * pi).alias("model_weight")
    )


def placed(events: DataFrame, block_targets: int = BLOCK_TARGETS) -> DataFrame:
    """3b CR and SR events dealt to blocks, written once."""
    rows = three_tag(events).select("event_id", "region", "sT", "weight")
    return materialize(round_robin_blocks(rows, block_targets), "blocks")


def block_side(blocks: DataFrame, region: str) -> DataFrame:
    return blocks.where(F.col("region") == region).select(
        "block", F.col("event_id").alias("id"), F.col("sT").alias("x"), F.col("weight").alias("w")
    )


def region_coupling(blocks: DataFrame) -> DataFrame:
    """CR to SR coupling of each block that moves mass in sT order."""
    return monotone_coupling(block_side(blocks, "CR"), block_side(blocks, "SR"))


def _coupled(events: DataFrame, block_targets: int, couple: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    blocks = placed(events, block_targets)
    return blocks, materialize(couple(blocks), "coupling")


def shared_coupling(events: DataFrame, block_targets: int = BLOCK_TARGETS) -> tuple[DataFrame, DataFrame]:
    """Blocks and their sT-ordered coupling, written once for all models that move mass by them."""
    return _coupled(events, block_targets, region_coupling)


def _assemble(events: DataFrame, parts: DataFrame) -> DataFrame:
    """All 3b events; regions that the model leaves out (SB) get model weight 0."""
    rows = three_tag(events).select("event_id", "region", "weight")
    return rows.join(parts, "event_id", "left").select(
        "event_id", "region", "weight", F.coalesce("model_weight", F.lit(0.0)).alias("model_weight")
    )


def nearest_sources(events: DataFrame, k: int, steps: int = HALF_STEPS) -> DataFrame:
    """k nearest 3b CR events of each 4b CR event by |delta sT|."""
    cr = events.where(F.col("region") == "CR").select("tag", F.col("event_id").alias("id"), F.col("sT").alias("x"))
    return knn_by_gap(cr.where(F.col("tag") == "4b"), cr.where(F.col("tag") == "3b"), k, steps)


def ot_knn(
    events: DataFrame,
    k: int,
    block_targets: int = BLOCK_TARGETS,
    steps: int = HALF_STEPS,
    neighbours: Callable[[DataFrame], DataFrame] | None = None,
    couple: Callable[[DataFrame], DataFrame] = region_coupling,
    shared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Neighbour weights of 3b CR events, pushed to SR through the block couplings.

    ``shared`` are written blocks and their coupling, where several models use the same ones.

    Both regions are rescaled to the 3b sum of the region times the transfer factor. The CR to CR
    coupling of a block at zero cost is the identity, so CR keeps the neighbour weights.
    """
    norms = transfer_norms(events)
    blocks, coupling = shared or _coupled(events, block_targets, couple)
    knn = nearest_sources(events, k, steps) if neighbours is None else neighbours(events)
    cr = blocks.where(F.col("region") == "CR").select("event_id").join(
        neighbour_weights(knn).select(F.col("src_id").alias("event_id"), "nn_weight"), "event_id", "left"
    ).fillna(0.0, ["nn_weight"])
    cr = materialize(cr, "nn_weights")
    moved = push(
        given_source(coupling), cr.select(F.col("event_id").alias("id"), F.col("nn_weight").alias("w")), "conditional"
    )
    sr = materialize(moved.select(F.col("tgt_id").alias("event_id"), F.col("pushed").alias("raw")), "moved")
    sum_sr = scalar(sr.agg(F.sum("raw").alias("s")), "s")
    sum_cr = scalar(cr.agg(F.sum("nn_weight").alias("s")), "s")
    pi = scalar(norms, "pi")
    parts = sr.select(
        "event_id", F.try_divide(F.col("raw") * scalar(norms, "w3b_SR") * pi, sum_sr).alias("model_weight")
    ).unionByName(cr.select(
        "event_id", F.try_divide(F.col("nn_weight") * scalar(norms, "w3b_CR") * pi, sum_cr).alias("model_weight")
    ))
    return _assemble(events, parts)


def ot_classifier(
    events: DataFrame,
    scores: DataFrame,
    score: str = "score",
    block_targets: int = BLOCK_TARGETS,
    couple: Callable[[DataFrame], DataFrame] = region_coupling,
    shared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Classifier odds of 3b CR events pushed through couplings of total mass 1 per block; ``shared`` as in ``ot_knn``."""
    norms = transfer_norms(events)
    blocks = shared[0] if shared else placed(events, block_targets)
    n_blocks = scalar(blocks.agg((F.max("block") + 1).cast("double").alias("n")), "n")
    pi = scalar(norms, "pi")
    cr = blocks.where(F.col("region") == "CR").join(
        scores.select("event_id", F.col(score).alias("_h")), "event_id"
    ).select("event_id", "block", "weight", odds(F.col("_h")).alias("odds"))
    cr = materialize(cr, "odds")
    sr = push(shared[1] if shared else couple(blocks), cr.select(F.col("event_id").alias("id"), F.col("odds").alias("w")))
    block_sums = cr.groupBy("block").agg(F.sum("weight").alias("_sum"))
    own = cr.join(block_sums, "block")
    parts = sr.select(
        F.col("tgt_id").alias("event_id"),
        (F.try_divide(pi * F.col("pushed"), n_blocks) * scalar(norms, "w3b_SR")).alias("model_weight"),
    ).unionByName(own.select(
        "event_id",
        (
            F.try_divide(F.try_divide(pi * F.col("odds") * F.col("weight"), F.col("_sum")), n_blocks) * scalar(norms, "w3b_CR")
        ).alias("model_weight"),
    ))
    return _assemble(events, parts)


def single_coupling(events: DataFrame, scores: DataFrame, score: str = "score", factor: float = 10000.0) -> DataFrame:
    """Odds of 3b SB events pushed to CR and to SR through one coupling each; SB keeps its odds.

    The transfer factor is the ratio of SB counts. Each target region is one block, so both couplings are
    found in the same ordered scans.
    """
    counts = events.where(F.col("region") == "SB").agg(
        F.sum((F.col("tag") == "4b").cast("double")).alias("n4"), F.sum((F.col("tag") == "3b").cast("double")).alias("n3")
    )
    pi = F.try_divide(scalar(counts, "n4"), scalar(counts, "n3"))
    rows = three_tag(events)
    columns = [F.col("event_id").alias("id"), F.col("sT").alias("x"), F.col("weight").alias("w")]
    targets = rows.where(F.col("region").isin("CR", "SR")).select(F.col("region").alias("block"), *columns)
    sources = rows.where(F.col("region") == "SB").select(F.explode(F.array(F.lit("CR"), F.lit("SR"))).alias("block"), *columns)
    sb = materialize(
        rows.where(F.col("region") == "SB").select("event_id").join(
            scores.select("event_id", F.col(score).alias("_h")), "event_id"
        ).select("event_id", odds(F.col("_h")).alias("odds")), "sb_odds"
    )
    moved = push(monotone_coupling(sources, targets), sb.select(F.col("event_id").alias("id"), F.col("odds").alias("w")))
    parts = sb.select("event_id", (F.lit(factor) * pi * F.col("odds")).alias("model_weight")).unionByName(
        moved.select(F.col("tgt_id").alias("event_id"), (F.lit(factor) * pi * F.col("pushed")).alias("model_weight"))
    )
    return _assemble(events, parts)


def long_weights(models: dict[str, DataFrame]) -> DataFrame:
    """(event_id, method, region, weight) of several models, one after the other."""
    out: DataFrame | None = None
    for name, df in models.items():
        part = df.select("event_id", F.lit(name).alias("method"), "region", F.col("model_weight").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out
