"""Classifiers on event features with Spark ML: training, scoring, averaging, sweeps."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagshift.functions import jets as J
from tagshift.operators.metrics import auc


def with_features(events: DataFrame) -> DataFrame:
    """Adds the feature vector of the event's jets; other columns stay."""
    keep = events.columns
    wide = J.with_quadjets(J.with_dijets(events))
    return wide.select(*keep, array_to_vector(J.feature_vector()).alias("features"))


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("tag") == "4b").cast("int"))


def estimator(kind: str, **options) -> Pipeline:
    """Pipeline for one of: logistic, boosted, forest (depth 3)."""
    common = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "train_weight"}
    if kind == "logistic":
        model = LogisticRegression(**common, **{"maxIter": 20, **options})
    elif kind == "boosted":
        model = GBTClassifier(**common, **{"maxIter": 10, "seed": 1, **options})
    elif kind == "forest":
        model = RandomForestClassifier(**common, **{"maxDepth": 3, "numTrees": 20, "seed": 1, **options})
    else:
        raise ValueError(f"unknown classifier {kind}")
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), model])


def train(df: DataFrame, kind: str = "logistic", **options) -> PipelineModel:
    """Needs ``features``, ``label`` and a non-negative ``train_weight``."""
    return estimator(kind, **options).fit(df.select("features", "label", "train_weight"))


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    keep = [c for c in df.columns if c != "features"]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def symmetric_score(model: PipelineModel, events: DataFrame, out: str = "score") -> DataFrame:
    """(event_id, score): mean score of the four flip copies of each event."""
    copies = events.select("event_id", "m4j", F.explode(J.symmetry_copies(F.col("jets"))).alias("c"))
    copies = copies.select("event_id", "m4j", F.col("c.jets").alias("jets"))
    scored = score(model, with_features(copies), "_s")
    return scored.groupBy("event_id").agg(F.avg("_s").alias(out))


def save(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def sweep(train_df: DataFrame, valid_df: DataFrame, grid: list[tuple[str, dict]]) -> DataFrame:
    """One row per setting: (classifier, setting, train_auc, valid_auc).

    The grid is a handful of settings; each fit is a Spark job over the whole training table.
    """
    out: DataFrame | None = None
    for kind, options in grid:
        model = train(train_df, kind, **options)
        tables = {"train_auc": train_df, "valid_auc": valid_df}
        cols = [
            auc(score(model, t), "score", "label", "train_weight").select("auc").scalar().alias(name)
            for name, t in tables.items()
        ]
        setting = ", ".join(f"{k}={v}" for k, v in sorted(options.items()))
        row = train_df.sparkSession.range(1).select(F.lit(kind).alias("classifier"), F.lit(setting).alias("setting"), *cols)
        out = row if out is None else out.unionByName(row)
    return out
