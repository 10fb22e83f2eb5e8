"""Training logs as a metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.operators.ordered import ordered_scan
from tagshift.sources.store import materialize

_NUMBER = r"([-+0-9.eE]+)"
# fixed values: layout of the two kinds of log line
VALIDATION_LINE = rf"^\s*>>\s*(\d+)/\d+\s*<<\s*Validation\s*\|\s*{_NUMBER}\s*\|\s*{_NUMBER}\s*\|\s*{_NUMBER}"
TRAINING_LINE = rf"^\s*(Training)\s*\|\s*{_NUMBER}\s*\|\s*{_NUMBER}\s*\|\s*{_NUMBER}"
HEADER_LINE = r"^\s*>>\s*Epoch\b"
OVERTRAIN = r"\^\s*([-+0-9.]+)%"


def read_history(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, epoch, split, loss, stat, auc, overtrain) of all logs in one pass.

    Logs are read by lines, so a long one is split like any file; a line's place is the start of its
    part and its number in it. A header line begins a new record, and lines before a file's last one
    are dropped. Training lines carry no epoch; the n-th of a record belongs to its n-th validation line.
    """
    logs = spark.read.text(list(paths))
    folders = [c for c in logs.columns if c != "value"]
    text = F.col("value")
    kind = F.when(text.rlike(VALIDATION_LINE), "validation").when(text.rlike(TRAINING_LINE), "training").when(text.rlike(HEADER_LINE), "header")
    lines = logs.select(
        *folders, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), text.alias("text"), kind.alias("split"),
    ).where(F.col("split").isNotNull())
    is_kind = {k: (F.col("split") == k).cast("long").alias(f"_{k}") for k in ("header", "validation", "training")}
    places = ordered_scan(lines.select("*", *is_kind.values()), ["_start", "_id"], by=["file"], running={f"n_{k}": f"_{k}" for k in is_kind}, rank=None)
    places = materialize(places, "lines")
    heads = places.groupBy("file").agg(F.sum("_header").alias("heads"))
    last = places.join(heads, "file").where((F.col("split") != "header") & (F.col("n_header") == F.col("heads")))
    begin = last.groupBy("file").agg(F.min("n_validation").alias("v0"), F.min("n_training").alias("t0"))
    pattern = lambda i: F.when(
        F.col("split") == "validation", F.regexp_extract("text", VALIDATION_LINE, i)
    ).otherwise(F.regexp_extract("text", TRAINING_LINE, i))
    parsed = last.join(begin, "file").select(
        *folders, "file", "split",
        F.when(F.col("split") == "validation", F.col("n_validation") - F.col("v0")).otherwise(F.col("n_training") - F.col("t0")).alias("_nth"),
        F.when(F.col("split") == "validation", pattern(1).cast("int")).alias("_epoch"),
        pattern(2).cast("double").alias("loss"), pattern(3).cast("double").alias("stat"), pattern(4).cast("double").alias("auc"),
        F.regexp_extract("text", OVERTRAIN, 1).try_cast("double").alias("overtrain"),
    )
    epochs = parsed.where("split = 'validation'").select("file", "_nth", F.col("_epoch").alias("epoch"))
    return parsed.drop("_epoch").join(epochs, ["file", "_nth"], "left").drop("_nth")


def log_lines(metrics: DataFrame, epochs: int, run: str = "run") -> DataFrame:
    """The lines of one log per run from (run, epoch, split, loss, stat, auc), in order: header, validation, training."""
    body = F.format_string(" | %.4f | %.2f | %.2f |", "loss", "stat", "auc")
    head = F.when(
        F.col("split") == "validation", F.format_string(">> %d/%d << Validation", F.col("epoch"), F.lit(epochs))
    ).otherwise("               Training")
    lines = metrics.select(run, "epoch", F.when(F.col("split") == "validation", 0).otherwise(1).alias("at"), F.concat(head, body).alias("value"))
    headers = metrics.select(run).distinct().select(run, F.lit(-1).alias("epoch"), F.lit(0).alias("at"), F.lit(">> Epoch <<   Data Set |  Loss  | Norm | AUC |").alias("value"))
    every = lines.unionByName(headers)
    # a log is one file, written in order
    return every.repartition(run).sortWithinPartitions(run, "epoch", "at").select(run, "value")
