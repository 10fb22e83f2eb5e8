"""Raw deliveries to several tables at once, each batch exactly once.

A file stream hands over the new files as numbered batches and keeps in ``progress`` which files a number stands for.
Every output of a batch goes to a folder of that number, which replaces what a broken attempt left there; so a job
that dies after writing and before the batch counts as done writes the same folders again when it is restarted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.sources.store import short_methods

Outputs = dict[str, Callable[[DataFrame], DataFrame]]
BATCH_BYTES = 8 << 30  # of the files of one batch; a delivery of many small files is one batch


def _new_files(spark: SparkSession, source: str, batch_bytes: int) -> DataFrame:
    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(source)


def convert_new_files(
    spark: SparkSession, source: str, root: str, progress: str, prepare: Callable[[DataFrame], DataFrame], outputs: Outputs,
    batch_bytes: int = BATCH_BYTES, after_write: Callable[[int], None] | None = None,
) -> None:
    """Feeds the files that arrived since the last call to every output: ``root``/name/batch=number.

    ``prepare`` is applied to a batch once, then each of ``outputs`` to its result. ``after_write`` is called with the number when a batch is
    written and not yet counted as done.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name, make in outputs.items():
                make(rows).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            rows.unpersist()
        if after_write is not None:
            after_write(number)

    query = (
        _new_files(spark, source, batch_bytes).writeStream.foreachBatch(run).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def converted(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What all batches wrote to one output."""
    return spark.read.parquet(f"{root}/{name}").drop("batch")


def update_catalogue(
    spark: SparkSession, source: str, path: str, progress: str, log: str, count: Callable[[DataFrame], DataFrame], keys: list[str], bins: list[str],
    replace: Callable[[DataFrame, str], None], batch_bytes: int = BATCH_BYTES,
) -> None:
    """Keeps a stored table of bins up to date with the files that arrive.

    ``count`` is an aggregation to (keys, bins, sums); its sums are the state of the stream, so a batch gives the new sums of the bins that it
    touches and nothing else. They go to ``log``, under the batch's number. Of the stored table only the groups of ``keys`` with such a bin are
    written again, whole, from the latest sums in the log: ``replace(table, path)`` puts them in place. The stored table itself is never read, so an attempt that broke
    while replacing a group is mended by the next one.
    """

    def run(touched: DataFrame, number: int) -> None:
        own = f"{log}/batch={number}"
        touched.write.mode("overwrite").parquet(own)
        new = spark.read.parquet(own)
        groups = new.select(*keys).distinct()
        sums = [c for c in new.columns if c not in (*keys, *bins)]
        known = spark.read.parquet(log).join(groups, keys, "left_semi").groupBy(*keys, *bins).agg(F.max_by(F.struct(*sums), "batch").alias("latest"))
        if not new.isEmpty():
            replace(known.select(*keys, *bins, "latest.*"), path)

    updates = count(_new_files(spark, source, batch_bytes)).writeStream.outputMode("update").foreachBatch(run)
    # a stream keeps the settings that hold when it starts
    with short_methods(spark):
        query = updates.option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
