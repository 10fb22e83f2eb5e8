"""Model against truth: histograms of every variable, with ratios, and the validation sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagshift.constants import HISTOGRAM_VARIABLES
from tagshift.operators import hist as H


def sample_histograms(
    events: DataFrame, weights: DataFrame, regions: tuple[str, ...] = ("CR", "SR"), variables: dict | None = None
) -> DataFrame:
    """Histograms of 3b events under every model in ``weights`` (event_id, method, weight).

    Events are joined once to the long weight table, so all models and variables share one shuffle.
    """
    variables = variables or HISTOGRAM_VARIABLES
    rows = events.where((F.col("tag") == "3b") & F.col("region").isin(*regions)).drop("weight")
    joined = rows.join(weights.select("event_id", F.col("method").alias("sample"), "weight"), "event_id")
    return H.fill(joined, variables, ["region", "sample"])


def truth_histograms(
    events: DataFrame, scale: float = 1.0, regions: tuple[str, ...] = ("CR", "SR"), variables: dict | None = None
) -> DataFrame:
    variables = variables or HISTOGRAM_VARIABLES
    rows = events.where((F.col("tag") == "4b") & F.col("region").isin(*regions))
    return H.fill(rows.withColumn("sample", F.lit("truth")), variables, ["region", "sample"], scale=scale)


def base_histograms(samples: dict[str, tuple[DataFrame, float]], regions: tuple[str, ...] = ("CR", "SR"), variables: dict | None = None) -> DataFrame:
    """Histograms of several samples, each at its own scale, in one shuffle: (region, sample, variable, bin, ...)."""
    out: DataFrame | None = None
    for name, (events, scale) in samples.items():
        part = events.where(F.col("region").isin(*regions)).withColumn("weight", F.col("weight") * F.lit(float(scale))).withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return H.fill(out, variables or HISTOGRAM_VARIABLES, ["region", "sample"])


def model_against_truth(models: DataFrame, truth: DataFrame, variables: dict | None = None) -> DataFrame:
    """Truth over model for every model, region, variable and inner bin, filled on either side or not."""
    variables = variables or HISTOGRAM_VARIABLES
    keys = ["region", "variable", "bin"]
    m = models.select(*keys, "sample", F.col("sumw").alias("den"), F.sqrt("sumw2").alias("den_err"))
    t = truth.select(*keys, F.col("sumw").alias("num"), F.sqrt("sumw2").alias("num_err"))
    # a few rows: samples and regions with anything at all, times the fixed binnings
    sides = m.select("region").unionByName(t.select("region")).distinct().join(m.select("sample").distinct())
    bins = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(H.bin_count(b)).alias("n")) for v, (_, b) in variables.items()])
    grid = sides.select("*", F.explode(bins).alias("v")).select(
        "sample", "region", "v.variable", F.explode(F.sequence(F.lit(1), F.col("v.n"))).alias("bin")
    )
    joined = grid.join(m, ["sample", *keys], "left").join(t, keys, "left").fillna(0.0, ["num", "num_err", "den", "den_err"])
    value, err = H.ratio(F.col("num"), F.col("den"), F.col("num_err"), F.col("den_err"))
    return H.with_edges(joined.withColumn("ratio", value).withColumn("ratio_err", err), variables)


def validation_set(events: DataFrame, model: DataFrame, region: str = "SR") -> DataFrame:
    """3b events with the model's weights and 4b events with their own, labelled 0 and 1."""
    rows = events.where(F.col("region") == region)
    three = rows.where(F.col("tag") == "3b").drop("weight").join(
        model.select("event_id", F.col("model_weight").alias("weight")), "event_id"
    )
    return three.unionByName(rows.where(F.col("tag") == "4b"), allowMissingColumns=True).withColumn(
        "label", (F.col("tag") == "4b").cast("int")
    )
