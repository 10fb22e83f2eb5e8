"""Incremental form of the chunked conversion: new raw files are appended as features once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def append_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    progress: str,
    convert: Callable[[DataFrame], DataFrame],
    files_per_chunk: int = 8,
) -> None:
    """Converts the files that arrived since the last call, chunk by chunk, and appends them.

    ``progress`` is the checkpoint folder of the stream; with it a restarted job neither skips nor
    repeats a file. ``convert`` has to work row by row, as the features do.
    """
    schema = spark.read.parquet(source).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
    query = (
        convert(raw).writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
