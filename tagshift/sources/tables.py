"""Scans, projections and sinks of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagshift.functions import fourvec as fv
from tagshift.sources.store import new_path

# fixed value: first year-like number in the name of the folder that holds the file
FILE_YEAR = r"/[^/]*?(201\d)[^/]*/[^/]*$"


def scan(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One or more Parquet paths or globs as one table; only the wanted columns are read."""
    df = spark.read.parquet(*paths)
    return df if columns is None else df.select(*columns)


def optional_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns that exist, cast to the wanted types; the others are left out."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items() if c in df.columns])


def with_file_facts(df: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``year`` and ``is_data`` read from the name of each row's file."""
    source = F.col("_metadata.file_path") if path is None else F.col(path)
    return df.select(
        "*",
        F.regexp_extract(source, FILE_YEAR, 1).cast("int").alias("year"),
        source.contains("data201").alias("is_data"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature table in single precision, the stored form of the features."""
    narrow = [
        F.col(f.name).cast("float").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*narrow).write.parquet(path)


def write_by_region(df: DataFrame, path: str) -> None:
    """One pass over the events, one folder per region."""
    df.write.partitionBy("region").parquet(path)


def write_catalogue(hist: DataFrame, path: str) -> None:
    """Replaces only the (region, sample) folders that ``hist`` holds."""
    hist.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region", "sample").parquet(path)


def write_blocks(cells: DataFrame, path: str) -> None:
    """Long block matrix, one folder per block.

    Rows are dealt by range, so a small block is one file and a large one is written by several tasks.
    """
    cells.repartitionByRange("block", "tgt_id", "src_id").write.partitionBy("block").parquet(path)


def replace_column(spark: SparkSession, path: str, values: DataFrame, column: str, default: float | None = None) -> str:
    """Joins a new column to a stored table by ``event_id`` and returns the path of the new version.

    The stored table is never overwritten while it is being read.
    """
    stored = spark.read.parquet(path).drop(column)
    joined = stored.join(values.select("event_id", column), "event_id", "left")
    if default is not None:
        joined = joined.fillna(default, [column])
    out = new_path(spark, "version")
    joined.write.parquet(out)
    return out


def kinematic_arrays(events: DataFrame, form: str) -> DataFrame:
    """(event_id, region, features) with one row of numbers per event.

    Forms: ``PtEtaPhi`` (12 numbers, phi in [0, 2 pi)), ``PtEtaPhiM`` and ``PxPyPzE`` (16 numbers).
    """
    j = [F.col("jets")[i] for i in range(4)]
    per_jet = {
        "PtEtaPhi": lambda x: [x["pt"], x["eta"], fv.unsigned_phi(x["phi"])],
        "PtEtaPhiM": lambda x: [x["pt"], x["eta"], x["phi"], fv.mass(fv.cartesian(x["pt"], x["eta"], x["phi"], x["e"]))],
        "PxPyPzE": lambda x: [
            x["pt"] * F.cos(x["phi"]), x["pt"] * F.sin(x["phi"]), x["pt"] * F.sinh(x["eta"]), x["e"]
        ],
    }[form]
    return events.select("event_id", "region", F.array(*[c for x in j for c in per_jet(x)]).alias("features"))
